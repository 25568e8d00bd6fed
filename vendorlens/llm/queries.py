"""The thin queries: each applies one operator to its whole table and derives the columns of its contract."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, langid, lines, mainhtml, phrases, quality, repair, secrets, sharding, simhash, warc
from .common import table

#: The tokenizer file; another one with the same word pattern may be named instead.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op1_html_main_text(spark, sf_dir):
    """Main text of every page."""
    return mainhtml.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _either_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_WORDS_OF_SECRETS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: kind, pattern whose last group is what must have the least length, that length.
_SECRET_PATTERNS = [
    ("assign", f"(?:{_WORDS_OF_SECRETS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    ("access", "(AKIA[A-Z0-9]+)", 20),
    ("hex", "([0-9a-f]+)", 24),
    ("private_key", "(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----)", 0),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 30),
    ("github", "((?:gh[pousr]|github_pat)_[A-Za-z0-9_]+)", 40),
    ("slack", "(xox[abeoprs]-[A-Za-z0-9-]+)", 15),
    ("stripe", "([rs]k_(?:live|test)_[A-Za-z0-9]+)", 24),
    ("google", "(AIza[A-Za-z0-9_-]+)", 39),
    ("bearer", f"{_either_case('bearer')} +([A-Za-z0-9+/_.~-]+=*)", 20),
    ("url_login", r"((?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%+-]+:[^\t-\r /@:]+@[A-Za-z0-9.-]+)", 0),
]


def _spans_sql():
    """A row for each match of each kind: what stands before it, and its own length, give its place."""
    parts = []
    for k, (kind, pattern, least) in enumerate(_SECRET_PATTERNS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_split_to_array(t, {p}) AS outer_, regexp_extract_all(t, {p}) AS found,
          regexp_extract_all(t, {p}, 1) AS value FROM d""")
    return " UNION ALL ".join(parts)


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_spans_sql()}),
     placed AS (SELECT doc_id, k, kind, length(found[i]) AS n, least, length(value[i]) AS v,
                  list_sum(list_transform(outer_[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s
                FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
     kept AS (SELECT doc_id, k, kind, s, concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + n AS BIGINT)) AS span FROM placed WHERE v >= least),
     listed AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                  string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM kept GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed l ON l.doc_id = d.doc_id""")
def op2_secret_scan(spark, sf_dir):
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]

    def written(spans):
        # Spans come sorted by start, then kind as listed.
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base),
                        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
  || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
  || html || chr(13) || chr(10) || chr(13) || chr(10)"""


@query(f"""
WITH records AS (SELECT page_id, {_RECORD} AS record FROM pages),
     placed AS (SELECT *, CAST(sum(strlen(record)) OVER (ORDER BY page_id) - strlen(record) AS BIGINT) AS start FROM records)
SELECT page_id, start AS "offset", strlen(record) AS length, start // 1073741824 AS volume, sha256(record) AS sha256,
       CASE WHEN page_id % 50 = 7 THEN 'changed' ELSE 'intact' END AS state
FROM placed""")
def op3_warc_fixity(spark, sf_dir):
    """Every page as a WARC record, audited against a replica with a wrong byte in one record of fifty."""
    records = warc.lay_out(warc.to_records(table(spark, sf_dir, "pages")))
    found = warc.audit(records, warc.bit_rot(records, F.col("record_id") % 50 == 7))
    # Hashed before the join: payloads stay where they are.
    rows = records.select("leaf", F.col("record_id").alias("page_id"), "offset", F.col("size").alias("length"), "volume", F.sha2("payload", 256).alias("sha256"))
    return rows.join(found, "leaf", "left").withColumn("state", F.coalesce("state", F.lit("intact"))).drop("leaf")


@query()
def op4_quality_nbsvm(spark, sf_dir):
    """Quality of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The checksum byte by byte, over a table of the 256 single bytes that the SQL itself works out.
_CRC_TABLE = """SELECT list(v ORDER BY i) AS t FROM (SELECT i, (WITH RECURSIVE s(n, r) AS (SELECT 0, i::UBIGINT UNION ALL
  SELECT n + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END FROM s WHERE n < 8) SELECT r FROM s WHERE n = 8) AS v
  FROM range(256) g(i))"""


@query(f"""
WITH crc AS ({_CRC_TABLE}),
     d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     sized AS (SELECT doc_id, strlen(text) + 1 AS size, md5(text) AS place, xor(list_reduce(list_transform(range(strlen(text)),
                 lambda i: CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS UBIGINT)), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]), 4294967295::UBIGINT),
                 4294967295::UBIGINT) AS crc FROM (SELECT *, hex(encode(text)) AS h FROM d), crc),
     summed AS (SELECT *, sum(size) OVER (ORDER BY place, doc_id) - size AS earlier, sum(size) OVER () AS total FROM sized),
     cut AS (SELECT *, least(15, CAST((earlier * 2 + size) * 16 // (2 * total) AS INTEGER)) AS shard FROM summed)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut""")
def op5_byte_shards(spark, sf_dir):
    """All documents in 16 shards of nearly equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op6_bpe_distinct_words(spark, sf_dir):
    """Every document encoded and decoded, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, outputs=("digests",))


@query()
def op7_language_ppm(spark, sf_dir):
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query()
def op8_simhash_popcount(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = """list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
     b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
     sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
     windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
                 FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
     lengths AS (SELECT DISTINCT n FROM windows),
     grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
     found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, gram)),
     hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY 1),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op9_decontaminate(spark, sf_dir):
    """What every document shares with the benchmark."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
           WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
     reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
     least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1),
     counted AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted USING (vec_id)""")
def op10_embedding_int8(spark, sf_dir):
    """Links and group of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


_PHRASE = """SELECT lang, g, count(*) AS f FROM ({}) GROUP BY 1, 2"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _cut(left, right):
    return f"CAST(1000000::HUGEINT * t.f * t.f // ({left}::HUGEINT * {right}) AS BIGINT)"


@query(f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
     one AS ({_PHRASE.format("SELECT lang, unnest(w) AS g FROM w")}),
     spots AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w),
     two AS ({_PHRASE.format("SELECT lang, w[i:i + 1] AS g FROM spots")}),
     three AS ({_PHRASE.format("SELECT lang, w[i:i + 2] AS g FROM spots WHERE i + 2 <= len(w)")}),
     n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY 1),
     longer AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM three WHERE f >= 10 UNION ALL SELECT lang, g[2:3], f FROM three WHERE f >= 10) GROUP BY 1, 2),
     scored AS (
       SELECT t.lang, t.g, t.f AS a, x.f AS l, y.f AS r, {_cut("x.f", "y.f")} AS score
       FROM two t JOIN one x ON x.lang = t.lang AND x.g = t.g[1] JOIN one y ON y.lang = t.lang AND y.g = t.g[2]
       LEFT JOIN longer o ON o.lang = t.lang AND o.g = t.g WHERE t.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * t.f)
       UNION ALL
       SELECT lang, g, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM (
         SELECT t.lang, t.g, t.f AS a, x.f AS l1, v.f AS r1, u.f AS l2, y.f AS r2, {_cut("x.f", "v.f")} AS s1, {_cut("u.f", "y.f")} AS s2
         FROM three t JOIN one x ON x.lang = t.lang AND x.g = t.g[1] JOIN one y ON y.lang = t.lang AND y.g = t.g[3]
         JOIN two u ON u.lang = t.lang AND u.g = t.g[1:2] JOIN two v ON v.lang = t.lang AND v.g = t.g[2:3] WHERE t.f >= 10)),
     ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
                  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op11_era_phrases(spark, sf_dir):
    """Collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


_TURN = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"


def _edit(state, cost, letter, added=None):
    """SQL of a path one edit longer: eight digits of cost, the edits, chr(1), the repaired turns."""
    cut = f"strpos({state}, chr(1))"
    turn = f" || chr(10) || {added}" if added else ""
    return f"printf('%08d', CAST(left({state}, 8) AS INTEGER) + {cost}) || substr({state}, 9, {cut} - 9) || '{letter}' || substr({state}, {cut}){turn}"


def _after_row():
    """SQL of the best path to each state after a row, from those before it."""
    paths = {q: [_edit(f"p{q}", 2, "D")] for q in range(4)}
    for role, ways in (("s", ((0, 1),)), ("u", ((0, 2), (1, 2), (3, 2))), ("a", ((2, 3),))):
        for q, to in ways:
            kept = _edit(f"p{q}", "CASE WHEN kind = 1 THEN 5 ELSE 0 END", "K", "role || ':' || text")
            paths[to].append(f"CASE WHEN kind < 2 AND left(role, 1) = '{role}' THEN {kept} END")
    for q, to, name in ((0, 2, "user"), (1, 2, "user"), (2, 3, "assistant"), (3, 2, "user")):
        moved = _edit(f"p{q}", "CASE WHEN kind = 1 THEN 6 ELSE 1 END", "R", f"'{name}:' || text")
        paths[to].append(f"CASE WHEN kind < 2 THEN {moved} END")
    return ", ".join(f"least(NULL, {', '.join(x)}) AS b{q}" for q, x in paths.items())


def _with_inserts(source):
    users = ", ".join(_edit(f"b{q}", 5, "I", "'user:'") for q in (0, 1, 3))
    return f"SELECT conv, i, b0 AS p0, b1 AS p1, p2, least(b3, {_edit('p2', 5, 'I', chr(39) + 'assistant:' + chr(39))}) AS p3 FROM (SELECT *, least(b2, {users}) AS p2 FROM ({source}))"


_VISIBLE = "regexp_replace(text, '[\x20\x09-\x0D]+$', '')"


@query(f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
     keyed AS (SELECT conv_id, turn, coalesce(CAST(role AS VARCHAR), ' ') AS role, coalesce(text, ' ') AS text, {_TURN} AS k FROM conversations),
     hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(strlen(k)),
                 lambda i: CAST(concat('0x', substr(hex(encode(k)), 2 * i + 1, 2)) AS UBIGINT)), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]), 4294967295::UBIGINT),
                 4294967295::UBIGINT) % 20 AS f FROM keyed, crc),
     damaged AS (SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS conv, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                   CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE f <> 0),
     placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, {_VISIBLE} AS visible FROM damaged),
     marked AS (SELECT conv, turn, role, text, i, CASE WHEN visible = '' THEN 2 WHEN i > min(i) OVER (PARTITION BY conv, role, text) THEN 3 WHEN right(visible, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS kind,
                  left(lag(role) OVER (PARTITION BY conv ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
     facts AS (SELECT conv, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 2) AS blank,
                 count(*) FILTER (kind = 3) AS duplicate, count(*) FILTER (kind = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1),
     steps AS ({_with_inserts("SELECT DISTINCT conv, 0 AS i, '00000000' || chr(1) AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, CAST(NULL AS VARCHAR) AS b3 FROM marked")}
       UNION ALL
       {_with_inserts(f"SELECT m.conv, CAST(m.i AS INTEGER) AS i, {_after_row()} FROM steps JOIN marked m ON m.conv = steps.conv AND m.i = steps.i + 1")}),
     best AS (SELECT s.conv, least(p0, p3) AS path FROM steps s JOIN facts f ON f.conv = s.conv AND f.rows = s.i),
     convs AS (SELECT DISTINCT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS conv FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(CAST(left(path, 8) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(substr(path, 9, strpos(path, chr(1)) - 9), '') AS audit,
       sha256(coalesce(substr(path, strpos(path, chr(1)) + 2), '')) AS repaired_sha256
FROM convs LEFT JOIN facts ON facts.conv = convs.conv LEFT JOIN best ON best.conv = convs.conv""")
def op12_checkpointed_repair(spark, sf_dir):
    """Every conversation, damaged by a hash of its turns and repaired."""
    turns = table(spark, sf_dir, "conversations")
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    role, said = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    damaged = (turns.withColumn("harm", harm).filter("harm <> 0")
               .select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(role).alias("role"),
                       F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
                       F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")))
    found = repair.repair(damaged, outputs=("sha256",)).withColumnRenamed("conv_id", "found_id").withColumn("repaired_sha256", F.col("sha256"))
    every = turns.select("conv_id").distinct().join(found, F.expr("conv_id <=> found_id"), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
     firsts AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
     m AS (SELECT l.*, first IS NOT NULL AND first IS DISTINCT FROM doc_id AS gone FROM l LEFT JOIN firsts USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r""")
def op13_perfect_hash_lines(spark, sf_dir):
    """Every document without the lines that a document with a smaller id keeps."""
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
