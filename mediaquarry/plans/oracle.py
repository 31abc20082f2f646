"""DuckDB SQL that gives the same rows as the queries, over the same tables."""

from __future__ import annotations

from ..functions import text as X
from ..operators.joblog import MODELS
from .queries import ASKED, BATCHES, BLOB_PIECE, CAPTIONS, RANGES, SEARCHES, TOPS

_CATEGORIES = """
categories AS (SELECT row_number() OVER (ORDER BY max(doc_id) DESC) AS id, lang AS name FROM documents GROUP BY lang),
creators AS (SELECT row_number() OVER (ORDER BY max(doc_id) DESC) AS id, source AS username FROM documents GROUP BY source)"""
_POSTS = (
    _CATEGORIES
    + """,
posts AS (
  SELECT d.doc_id + 1 AS video_id, c.id AS category_id, r.id AS creator_id, d.n_chars AS likes, d.text AS caption,
         CASE WHEN l.doc_id IS NOT NULL THEN '/lake/videos/video_' || (d.doc_id + 1) || '.mp4' END AS local_video_path,
         CASE WHEN l.doc_id IS NULL THEN 'Metadata_Only' WHEN l.toxic = 0 THEN 'Harvested' ELSE 'Error' END AS status
  FROM documents d JOIN categories c ON c.name = d.lang JOIN creators r ON r.username = d.source
  LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
)
_NAMED = (
    _POSTS
    + """,
named AS (
  SELECT p.*, c.name AS category, r.username AS creator, regexp_extract(p.local_video_path, '([^/]*)$', 1) AS filename
  FROM posts p JOIN categories c ON c.id = p.category_id JOIN creators r ON r.id = p.creator_id
  WHERE p.local_video_path IS NOT NULL
)"""
)
_QUEUE = "queue AS (SELECT * FROM (VALUES ('de', 0), ('fr', 1)) AS v(category, rank))"
_PRESENT = "present AS (SELECT doc_id + 1 AS id FROM labels), missing AS (SELECT unnest(range(1, (SELECT max(id) FROM present) + 1)) AS id EXCEPT SELECT id FROM present)"
_LOG = """
log AS (
  SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'RPUSH' WHEN 'view' THEN 'LPOP' ELSE 'SADD' END AS op,
         CASE WHEN user_id % 2 = 0 THEN 'QUEUE_A' ELSE 'QUEUE_B' END AS key, props AS value, user_id
  FROM events WHERE event_type IN ('click', 'view', 'signup')
)"""
_DEPTHS = (
    _LOG
    + """,
sums AS (
  SELECT seq, key, op, sum(CASE WHEN op = 'RPUSH' THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY seq) AS total
  FROM log WHERE op <> 'SADD'
), floors AS (SELECT *, min(total) OVER (PARTITION BY key ORDER BY seq) AS least FROM sums),
depths AS (SELECT seq, key, op, total - least(0, least) AS depth FROM floors)"""
)


def _browse(offset: int | str) -> str:
    return f"WITH {_NAMED} SELECT video_id AS id, creator, category, format('{{:,}}', likes) AS likes, caption, filename FROM named ORDER BY video_id DESC LIMIT 30 OFFSET {offset}"


def _playlist(where: str) -> str:
    return f"WITH {_NAMED} SELECT creator AS username, category AS name, likes, caption, filename, video_id AS id FROM named {where}"


_TOKENS = r"""
docs AS (SELECT doc_id + 1 AS video_id, text AS caption, source AS creator, lang AS category FROM documents),
fields AS (
  SELECT video_id, 'caption' AS col, caption AS x FROM docs UNION ALL SELECT video_id, 'creator', creator FROM docs
  UNION ALL SELECT video_id, 'category', category FROM docs
),
lists AS (SELECT video_id, col, regexp_extract_all(strip_accents(lower(x)), '[\p{L}\p{N}\p{Co}]+') AS t FROM fields),
postings AS (SELECT video_id, col, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM lists),
lengths AS (SELECT video_id, sum(len(t)) AS n FROM lists GROUP BY video_id),
stats AS (SELECT count(*) AS n_docs, sum(n) AS n_tokens FROM lengths)"""


def _search(phrases: list[str], holds: str, scored: list[int], offset: int | str = 0, counted: dict[int, int] | None = None) -> str:
    """``offset`` may ask named and rows; ``counted``: phrases whose docs are counted by another one; ``phrases``: SELECTs of a row (video_id) for each instance; ``holds``: a condition on tf0, tf1...; ``scored``: their numbers."""
    names = range(len(phrases))
    ctes = ", ".join(f"p{i} AS (SELECT video_id, count(*) AS tf FROM ({sql}) GROUP BY video_id)" for i, sql in enumerate(phrases))
    tfs = ", ".join(f"coalesce(p{i}.tf, 0) AS tf{i}" for i in names)
    joins = " ".join(f"LEFT JOIN p{i} USING (video_id)" for i in names)
    dfs = ", ".join(f"(SELECT count(*) FROM p{i}) AS df{i}" for i in names)

    def term(i: int) -> str:
        df = f"df{(counted or {}).get(i, i)}"
        idf = f"ln((n_docs - {df} + 0.5) / ({df} + 0.5))"
        return f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / (n_tokens / n_docs)))"

    return f"""WITH {_NAMED}, {_TOKENS}, {ctes},
rows AS (SELECT video_id, n, n_docs, n_tokens, {tfs}, {dfs} FROM lengths {joins}, stats)
SELECT named.video_id AS id, docs.creator, docs.category, format('{{:,}}', likes) AS likes, docs.caption, filename,
       round(-({" + ".join(map(term, scored))}), 6) AS rank
FROM rows JOIN named USING (video_id) JOIN docs USING (video_id) WHERE {holds}
ORDER BY -({" + ".join(map(term, scored))}), named.video_id LIMIT 30 OFFSET {offset}"""


def _token(word: str, prefix: bool = False, more: str = "") -> str:
    return f"SELECT video_id FROM postings WHERE {f"token LIKE '{word}%'" if prefix else f"token = '{word}'"}{more}"


_PAIR = "SELECT a.video_id FROM postings a JOIN postings b ON a.video_id = b.video_id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the'"

def _near(words: tuple[str, str], mine: int, distance: int) -> str:
    """Places of one of two words with the other so near that no more than ``distance`` tokens lie between them."""
    x, y = words[mine], words[1 - mine]
    return f"SELECT DISTINCT a.video_id, a.col, a.pos FROM postings a JOIN postings b ON a.video_id = b.video_id AND a.col = b.col AND abs(a.pos - b.pos) <= {distance + 1} WHERE a.token = '{x}' AND b.token = '{y}'"


def _list(values: tuple[str | None, ...]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _label(label: str) -> str:
    return rf"CASE WHEN regexp_matches(c, '{label}\s*(.+)') THEN trim(regexp_extract(c, '{label}\s*(.+)', 1), {_WHITE}) ELSE 'Unknown' END"


_ODD = rf"""odd AS (
  SELECT event_id AS id, coalesce(list_extract({_list(CAPTIONS)}, CAST(event_id % {len(CAPTIONS)} AS INTEGER) + 1), '') AS c FROM events
), read AS (
  SELECT id, {_label(X.CATEGORY_LABEL)} AS category, {_label(X.CREATOR_LABEL)} AS creator,
         CASE WHEN regexp_matches(c, '{X.LIKES_LABEL}\s*[\p{{Nd}},]+')
              THEN TRY_CAST(replace(translate(regexp_extract(c, '{X.LIKES_LABEL}\s*([\p{{Nd}},]+)', 1), '\u0661\u0662\u0663', '123'), ',', '') AS BIGINT) ELSE 0 END AS likes,
         trim(regexp_extract(c, '(?s){X.CAPTION_LABEL}\n(.*?)(?:\n{X.LINK_LABEL}|\n?\z)', 1), {_WHITE}) AS caption FROM odd
)""".replace("\\u0661\\u0662\\u0663", "\u0661\u0662\u0663")

ORACLES: dict[str, str] = {
    "browse_page": _browse(0),
    "browse_page_offset": _browse(30),
    "browse_page_deep": _browse("(SELECT count(*) * 9 // 10 FROM named)"),
    "playlist_all": _playlist(""),
    "playlist_category": _playlist("WHERE category = 'de'"),
    "category_list": "SELECT 0 AS position, 'All Categories' AS name UNION ALL SELECT DISTINCT 1, lang FROM documents",
    "category_menu_order": f"WITH {_QUEUE}, names AS (SELECT 'All Categories' AS name UNION ALL SELECT DISTINCT lang FROM documents) SELECT name, coalesce(CAST(rank + 1 AS VARCHAR), '') AS label, rank FROM names LEFT JOIN queue ON queue.category = name",
    "caption_parse": rf"""WITH messages AS (
  SELECT doc_id + 1 AS id, '{X.CATEGORY_LABEL} ' || lang || chr(10) || '{X.CREATOR_LABEL} ' || source || chr(10) || '{X.LIKES_LABEL} ' || format('{{:,}}', n_chars)
         || chr(10) || '{X.CAPTION_LABEL}' || chr(10) || text || chr(10) || '{X.LINK_LABEL} none' AS c FROM documents)
SELECT id, regexp_extract(c, '{X.CATEGORY_LABEL}\s*(.+)', 1) AS category, regexp_extract(c, '{X.CREATOR_LABEL}\s*(.+)', 1) AS creator,
       CAST(replace(regexp_extract(c, '{X.LIKES_LABEL}\s*([\d,]+)', 1), ',', '') AS BIGINT) AS likes,
       md5(regexp_extract(c, '(?s){X.CAPTION_LABEL}\n(.*?)(?:\n{X.LINK_LABEL}|\n?\z)', 1)) AS caption_md5 FROM messages""",
    "caption_quirks": f"WITH {_ODD} SELECT * FROM read",
    "held_counts": f"WITH {_ODD} SELECT count(*) AS n_rows, count(*) FILTER (likes IS NULL) AS n_held FROM read",
    "sync_docs": "SELECT doc_id + 1 AS video_id, source AS creator, lang AS category, md5(text) AS caption_md5 FROM documents",
    "media_filter": "SELECT event_id AS id FROM events WHERE event_type IN ('click', 'purchase')",
    "missing_ids": f"WITH {_PRESENT} SELECT id FROM missing",
    "missing_chunks": f"WITH {_PRESENT} SELECT id, CAST((row_number() OVER (ORDER BY id DESC) - 1) // 200 AS BIGINT) AS chunk FROM missing",
    "missing_ranges": f"""WITH {_PRESENT}, placed AS (SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS n FROM missing), islands AS (SELECT id + n AS island, min(id) AS first, max(id) AS last, min(n) AS a, max(n) AS z FROM placed GROUP BY ALL)
SELECT first, last, CAST(a // 200 AS BIGINT) AS chunk_of_last, CAST(z // 200 AS BIGINT) AS chunk_of_first FROM islands""",
    "dim_surrogate_keys": """WITH seen AS (SELECT c_name AS name, max(o_orderkey) AS seen FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 0 GROUP BY c_name)
SELECT (SELECT coalesce(max(c_custkey), 0) FROM customer WHERE c_nationkey = 0) + row_number() OVER (ORDER BY seen DESC) AS id, name FROM seen""",
    "upsert_first_wins": """SELECT user_id, event_id, value FROM events WHERE event_type = 'click' AND user_id % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    "status_machine": f"""WITH {_POSTS}, outcomes AS (SELECT user_id + 1 AS video_id, event_id AS seq, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase', 'error')),
last AS (SELECT video_id, arg_max(ok, seq) AS ok, bool_or(ok) AS ever FROM outcomes GROUP BY video_id)
SELECT p.video_id, CASE WHEN l.ok IS NULL THEN p.status WHEN l.ok THEN 'Harvested' ELSE 'Error' END AS status,
       CASE WHEN l.ever THEN '/lake/videos/video_' || p.video_id || '.mp4' ELSE p.local_video_path END AS local_video_path
FROM posts p LEFT JOIN last l ON l.video_id = p.video_id""",
    "sync_catalog": f"WITH {_POSTS} SELECT video_id, category_id, creator_id, likes, 'Metadata_Only' AS status, true AS waits FROM posts",
    "sync_increment": f"""WITH numbered AS (
  SELECT *, doc_id + 1 AS id, (SELECT max(doc_id) + 1 FROM documents) AS top FROM documents
), batches AS (
  SELECT *, CASE WHEN id <= top * {BATCHES[0]} // 100 THEN 0 WHEN id <= top * {BATCHES[1]} // 100 THEN 1 ELSE 2 END AS batch FROM numbered
), categories AS (
  SELECT name, row_number() OVER (ORDER BY min(batch), arg_min(seen, batch) DESC) AS id FROM (SELECT lang AS name, batch, max(id) AS seen FROM batches GROUP BY ALL) GROUP BY name
), creators AS (
  SELECT name, row_number() OVER (ORDER BY min(batch), arg_min(seen, batch) DESC) AS id FROM (SELECT source AS name, batch, max(id) AS seen FROM batches GROUP BY ALL) GROUP BY name
)
SELECT b.id AS video_id, c.id AS category_id, r.id AS creator_id, n_chars AS likes, CASE WHEN l.doc_id IS NULL THEN 'Metadata_Only' WHEN toxic = 0 THEN 'Harvested' ELSE 'Error' END AS status,
       CASE WHEN l.doc_id IS NOT NULL THEN '/lake/videos/video_' || b.id || '.mp4' END AS local_video_path
FROM batches b JOIN categories c ON c.name = lang JOIN creators r ON r.name = source LEFT JOIN labels l ON l.doc_id = b.doc_id""",
    "browse_segments": _browse("(SELECT count(*) * 5 // 10 FROM named)"),
    "search_segments": _search([_token("th", True)], "tf0 > 0", [0]),
    "pending_order": f"WITH {_POSTS}, {_QUEUE} SELECT video_id, row_number() OVER (ORDER BY rank NULLS LAST, video_id DESC) AS place FROM posts JOIN categories c ON c.id = category_id LEFT JOIN queue ON queue.category = c.name WHERE status = 'Metadata_Only'",
    "next_target": f"WITH {_POSTS}, {_QUEUE} SELECT video_id, CASE WHEN rank IS NULL THEN 'Global' ELSE c.name END AS target FROM posts JOIN categories c ON c.id = category_id LEFT JOIN queue ON queue.category = c.name WHERE status = 'Metadata_Only' ORDER BY rank NULLS LAST, video_id DESC LIMIT 1",
    "queue_left": f"WITH {_POSTS}, {_QUEUE} SELECT category, rank FROM queue WHERE category IN (SELECT c.name FROM posts JOIN categories c ON c.id = category_id WHERE status = 'Metadata_Only')",
    "schedule_replay": f"""WITH RECURSIVE {_POSTS}, waiting AS (
  SELECT category_id AS c, list(video_id ORDER BY video_id DESC) AS ids, count(*) AS n FROM posts WHERE status = 'Metadata_Only' GROUP BY category_id
), lists AS (
  SELECT list(coalesce(ids, []) ORDER BY id) AS ids, CAST(count(*) AS BIGINT) AS k, list(name ORDER BY id) AS names, sum(n) AS total FROM categories LEFT JOIN waiting ON c = id
), log AS (
  SELECT event_id AS seq, 0 AS c FROM events WHERE event_type = 'view'
  UNION ALL SELECT event_id, id FROM events JOIN categories ON id % {ASKED} = user_id % {ASKED + 1} AND id % {ASKED} > 0 WHERE event_type = 'signup'
), steps AS (
  SELECT *, row_number() OVER (ORDER BY seq) AS i, CAST(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS place FROM log QUALIFY place <= (SELECT total FROM lists)
), run(i, seq, place, asked, taken, best) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), list_transform(range(k), lambda x: CAST(0 AS BIGINT)), list_transform(range(k), lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT[]) FROM lists
  UNION ALL
  SELECT i, seq, place, list_transform(range(1, k + 1), lambda x: CASE WHEN x = c THEN seq + 1 ELSE asked[x] END), list_transform(range(1, k + 1), lambda x: taken[x] + CASE WHEN x = best[3] THEN 1 ELSE 0 END), best
  FROM (
    SELECT s.i, s.seq, s.place, s.c, k, asked, taken,
           CASE WHEN s.c = 0 THEN list_max(list_transform(list_filter(range(1, k + 1), lambda x: taken[x] < len(ids[x])), lambda x: [asked[x], ids[x][taken[x] + 1], x])) END AS best
    FROM run r JOIN steps s ON s.i = r.i + 1, lists
  )
)
SELECT seq, place, best[2] AS video_id, CASE WHEN best[1] = 0 THEN 'Global' ELSE names[best[3]] END AS target FROM run, lists WHERE best IS NOT NULL""",
    "corpus_stats": f"WITH {_TOKENS} SELECT CAST(n_docs AS BIGINT) AS n_docs, CAST(n_tokens AS BIGINT) AS n_tokens FROM stats",
    "term_stats": f"WITH {_TOKENS} SELECT token, col, CAST(count(DISTINCT video_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM postings GROUP BY token, col",
    "term_blocks": f"""WITH {_TOKENS}, keys AS (
  SELECT video_id, col, token AS key FROM postings
  UNION ALL SELECT video_id, col, substring(token, 1, k) || '*' FROM postings, (VALUES (1), (2), (3)) v(k) WHERE length(token) >= k
), places AS (SELECT * FROM keys UNION ALL SELECT video_id, '*', key FROM keys),
by_doc AS (SELECT video_id // 256 AS block, key, col, count(*) AS tf, any_value(n) AS length FROM places JOIN lengths USING (video_id) GROUP BY video_id, key, col),
shortest AS (SELECT key, col, block, tf, min(length) AS length, count(*) AS n FROM by_doc GROUP BY ALL),
best AS (SELECT *, sum(n) OVER (PARTITION BY key, col, block) AS df, min(length) OVER (PARTITION BY key, col, block ORDER BY tf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS beyond FROM shortest)
SELECT key, col, block, CAST(df AS BIGINT) AS df, CAST(tf AS BIGINT) AS tf, CAST(length AS BIGINT) AS length FROM best WHERE beyond IS NULL OR length < beyond""",
    "dedup_gate": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "dedup_gate_stream": "SELECT DISTINCT user_id FROM events",
    "queue_depth_replay": f"WITH {_DEPTHS} SELECT seq, key, op, CAST(depth AS BIGINT) AS depth FROM depths",
    "queue_final": f"WITH {_DEPTHS} SELECT key, CAST(count(*) FILTER (op = 'RPUSH') AS BIGINT) AS pushed, CAST(count(*) FILTER (op = 'RPUSH') - arg_max(depth, seq) AS BIGINT) AS popped, CAST(arg_max(depth, seq) AS BIGINT) AS depth FROM depths GROUP BY key",
    "fifo_match": f"""WITH {_DEPTHS}, befores AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY key ORDER BY seq) AS before FROM depths),
pushes AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM depths WHERE op = 'RPUSH'),
pops AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM befores WHERE op = 'LPOP' AND before > 0)
SELECT p.key, p.n, p.seq AS pushed_at, q.seq AS popped_at FROM pushes p LEFT JOIN pops q ON p.key = q.key AND p.n = q.n""",
    "set_replay": f"WITH {_LOG} SELECT DISTINCT key, CAST(user_id AS VARCHAR) AS value FROM log WHERE op = 'SADD'",
    "gate_audit": f"WITH {_LOG} SELECT seq, seq % 4001 AS msg_id FROM log WHERE op = 'RPUSH' AND seq % 4001 NOT IN (SELECT seq % 4001 FROM log WHERE op = 'SADD')",
    "queue_json_decode": f"WITH {_LOG} SELECT seq, key, CAST(json_extract_string(value, '$.k') AS BIGINT) AS k FROM log WHERE op = 'RPUSH'",
    "queue_json_encode": f"""WITH {_NAMED} SELECT video_id AS msg_id, '{{"msg_id":' || video_id || ',"path":"' || local_video_path || '"}}' AS payload FROM named""",
    "registry_dispatch": f"WITH jobs AS (SELECT event_id AS seq, list_extract({[*MODELS, 'unknown', 'YOLO']}, CAST(event_id % 9 AS INTEGER) + 1) AS model_name FROM events) SELECT seq, model_name, upper(model_name) || ' loaded' AS report FROM jobs WHERE model_name IN {MODELS}",
    "codec_route": "SELECT event_id, CASE WHEN event_id % 8 IN (4, 5, 7) THEN 'transcode' ELSE 'remux' END AS route FROM events",
    "log_filter": """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '[ENGINE] ' ELSE '[UI] ' END
       || CASE event_type WHEN 'click' THEN 'Loading weights: ' WHEN 'view' THEN '10%|## ' ELSE 'ready ' END || props AS line
FROM events WHERE NOT (user_id % 2 = 0 AND event_type IN ('click', 'view'))""",
    "log_shapes": """WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_type = 'error' THEN 'nothing' ELSE CASE event_type WHEN 'click' THEN 'open https://host-' WHEN 'view' THEN 'http://host-' ELSE 'no address ' END
       || user_id || '.example.org/x https://second.example.org' END AS line, user_id FROM events)
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'https://host-' || user_id || '.example.org' ELSE 'https://second.example.org' END AS url, '[' || strftime(ts, '%H:%M:%S') || '] ' || line AS line FROM e""",
    "byte_range": rf"""WITH f AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS size, list_extract({_list(RANGES)}, CAST(doc_id % {len(RANGES)} AS INTEGER) + 1) AS h FROM documents),
g AS (SELECT *, regexp_extract(h, 'bytes=(\d+)-(\d*)', 1) AS x, regexp_extract(h, 'bytes=(\d+)-(\d*)', 2) AS y FROM f),
r AS (SELECT *, CASE WHEN x = '' THEN 0 ELSE least(coalesce(TRY_CAST(x AS BIGINT), 4611686018427387904), 4611686018427387904) END AS first,
             CASE WHEN y = '' THEN size - 1 ELSE least(coalesce(TRY_CAST(y AS BIGINT), 4611686018427387904), 4611686018427387904) END AS last FROM g),
s AS (SELECT *, greatest(0, least(last + 1, size) - first) AS sent FROM r)
SELECT doc_id, 'bytes ' || first || '-' || last || '/' || size AS content_range, CAST(last - first + 1 AS BIGINT) AS length,
       md5(CASE WHEN sent = 0 THEN ''::BLOB ELSE b[first + 1 : first + sent] END) AS body_md5, CAST(greatest(0, (last - first + 1 + 999) // 1000) AS BIGINT) AS pieces,
       CAST((sent + 999) // 1000 AS BIGINT) AS pieces_sent FROM s""",
    "blob_pieces": f"SELECT doc_id, CAST((octet_length(encode(text)) + {BLOB_PIECE - 1}) // {BLOB_PIECE} AS BIGINT) AS pieces, md5(text) AS body_md5 FROM documents",
    "log_commands": f"""WITH {_LOG} SELECT op, key, CASE WHEN op = 'RPUSH' THEN seq || CASE WHEN user_id % 5 = 0 THEN chr(13) || chr(10) || '*1' || chr(13) || chr(10) || '$4' || chr(13) || chr(10) || 'PING' || chr(13) || chr(10) ELSE ' ' END || value END AS value
FROM log WHERE op <> 'SADD'""",
    "ui_row_format": f"WITH {_NAMED} SELECT video_id AS id, '@' || creator AS creator, category, format('{{:,}}', likes) AS likes, substring(caption, 1, 60) || '...' AS caption FROM named",
    "time_format": """WITH s AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN abs(value) * 10 END AS s, abs(value) AS v FROM events)
SELECT event_id, CASE WHEN s IS NULL THEN '0:00' ELSE CAST(floor(s / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(s % 60) AS BIGINT) AS VARCHAR), 2, '0') END AS shown, printf('%.2f', floor(v / 256.0 * 100 * 100 + 0.5) / 100) AS percent FROM s""",
    "scalar_functions": """SELECT p_partkey, 'video_' || p_partkey || '.mp4' AS file, substring(p_name || ' ' || p_type, 1, 12) AS short, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS state,
       CASE WHEN p_size - 10 < 20 THEN greatest(0, p_size - 10) END AS clamped, round(p_partkey * 1000000000 / 1073741824.0, 1) AS gib, p_partkey * 100000000 / 1073741824.0 >= 5 AS admitted, p_brand AS base, upper(p_name) AS loud FROM part""",
    "search_prefix": _search([_token("th", True)], "tf0 > 0", [0]),
    "search_multi": _search([_token("und"), _token("de", True)], "tf0 > 0 AND tf1 > 0", [0, 1]),
    "search_page2": _search([_token("th", True)], "tf0 > 0", [0], 30),
    "search_page_deep": _search([_token("th", True)], "tf0 > 0", [0], "(SELECT count(*) * 9 // 10 FROM rows JOIN named USING (video_id) WHERE tf0 > 0)"),
    "search_phrase": _search([_PAIR, _token("th", True)], "tf0 > 0 AND tf1 > 0", [0, 1]),
    "search_column": _search([_token("de", True, " AND col = 'category'")], "tf0 > 0", [0]),
    "search_or": _search([_token("worthless"), _token("mente", True)], "tf0 > 0 OR tf1 > 0", [0, 1]),
    "search_not": _search([_token("idiot"), _token("trash", True)], "tf0 > 0 AND tf1 = 0", [0]),
    "search_near": _search([_near(("of", "the"), 0, 3), _near(("of", "the"), 1, 3), _token("th", True), _token("of"), _token("the")], "tf0 > 0 AND tf1 > 0 AND tf2 > 0", [0, 1, 2], counted={0: 3, 1: 4}),
    "search_no_token": _search([_token("th", True)], "tf0 > 0", [0]),
    "search_blank": _browse(0),
    "search_space": _search([_token("of"), _token("the", True)], "tf0 > 0 AND tf1 > 0", [0, 1]),
    "search_nothing": "SELECT CAST(NULL AS BIGINT) AS id, NULL AS creator, NULL AS category, NULL AS likes, NULL AS caption, NULL AS filename, CAST(NULL AS DOUBLE) AS rank WHERE false",
    "search_initial": _search([_token("the", False, " AND pos = 1"), _token("un", True, " AND pos = 1")], "tf0 > 0 OR tf1 > 0", [0, 1]),
}

ORACLES |= {name: ORACLES[other] for name, other in (("queue_depth_stream", "queue_depth_replay"), ("fifo_match_stream", "fifo_match"), *TOPS.items())}

assert not SEARCHES.keys() - ORACLES.keys()
