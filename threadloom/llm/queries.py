"""The corpus queries: each applies one operator to its whole table and derives the columns it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, chat, decontaminate, divergence, language, repeats, simhash, tokenfiles, toxicity, trie, urls, vectors, warc
from threadloom.plans.scratch import cut


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Number and digest of each text's token ids, and the digest of what they decode to."""
    found = bpe.encode(docs.select("doc_id", "text"), back=True)
    return found.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hits = F.aggregate(F.arrays_zip("begin", "end"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return (
        decontaminate.contamination(docs, bench)
        .withColumn("n_hit", hits)
        .select(
            "row.doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def _bucket(column: str, n: int) -> F.Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % n


def language_model(docs: DataFrame) -> language.Model | None:
    """Learned from the documents whose crc32(doc_id) mod 3 is not 1."""
    return language.fit(docs.where(_bucket("doc_id", 3) != 1), by=F.xxhash64("doc_id"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(docs.select("doc_id", "text"), language_model(docs))
    held_out = F.coalesce(_bucket("row.doc_id", 3) == 1, F.lit(False))
    return found.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(_bucket("doc_id", 5) != 0))
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return found.select(
        "row.doc_id",
        F.coalesce(_bucket("row.doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


URL_RULES = (
    urls.Rule("block", "com/en/"),
    urls.Rule("allow", "example.com/en/7"),
    urls.Rule("allow", "net/de/"),
    urls.Rule("block", "example.net/de/8"),
    urls.Rule("block", "org/es/"),
)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(pages.select("page_id", "url"), urls.fit(pages, URL_RULES, html_col="html"), URL_RULES).select("row.page_id", "host", "path", "rule", "verdict", "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules alone, by the joins that any number of them takes: what SQL can say of ``op1_urls``."""
    host, path = urls.host_and_path(F.col("url"))
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    return urls.matched_by_join(given, URL_RULES).withColumnRenamed("_tl_action", "action")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def vectors_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_vectors`` with leaves so small that every label is split, by several levels of the trees."""
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), leaf=8).withColumnRenamed("id", "vec_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select("conv_id", "turn", "role", "action", "new_role", "inserted", "cost", "last", F.sha2("piece", 256).alias("piece_sha256"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return tokenfiles.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with the first turns of the first one of their five, so that prefixes are shared."""
    turns = cut(trie.ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    rebuilt = trie.with_heads_of(turns, F.col("c") - F.col("c") % 5, F.crc32(F.col("c").cast("string")) % 9, 8)
    return trie.prefix_trie(rebuilt, turns.select("c").distinct())


QUERIES = {
    "op7_chat": op7_chat,
    "op4_vectors": op4_vectors,
    "vectors_forest": vectors_forest,
    "op1_urls": op1_urls,
    "url_rules": url_rules,
    "op8_warc": op8_warc,
    "op5_toxicity": op5_toxicity,
    "op2_language": op2_language,
    "op3_decontaminate": op3_decontaminate,
    "op10_bpe": op10_bpe,
    "op6_repeats": op6_repeats,
    "op9_simhash": op9_simhash,
    "op11_tokens": op11_tokens,
    "op12_divergence": op12_divergence,
    "op13_trie": op13_trie,
}

def _chat_oracle(costs: chat.Costs) -> str:
    """The automaton's moves as literals; the dynamic programme, its ties and the pieces in SQL."""
    text = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    moves, ends = [], []
    for role, states in costs.moves().items():
        for state, choices in enumerate(states):
            for k, c in enumerate(choices):
                head = chat.piece(c, state, "", False)
                moves.append(f"({role}, {state}, {k}, {c[0]}, {c[1]}, '{c[2]}', '{chat.ROLES[c[1]]}', {len(c[3])}, {text(head)})")
    for state, cost in enumerate(costs.ending()):
        tail = chat.piece((0, state, "merge", ()), state, "", True)[1:]
        ends.append(f"({state}, {cost}, {len(chat._ENDING[state])}, {text(tail)})")
    names = " ".join(f"WHEN '{name}' THEN {code}" for name, code in chat.ALIASES.items())
    return f"""
WITH RECURSIVE moves(role, state, k, cost, nxt, action, new_role, ins, head) AS (VALUES {", ".join(moves)}),
ends(state, cost, ins, tail) AS (VALUES {", ".join(ends)}),
t AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE lower(trim(coalesce(role, ''))) {names} ELSE 0 END AS code,
        row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, md5(conversations.text) NULLS FIRST)),
dp AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, {{'c': CAST(0 AS BIGINT), 'p': ''}} AS best FROM t
    UNION ALL
    SELECT d.conv_id, d.n + 1, m.nxt, min({{'c': d.best.c + m.cost, 'p': d.best.p || CAST(m.k AS VARCHAR)}})
    FROM dp d JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.n = d.n + 1 JOIN moves m ON m.role = t.code AND m.state = d.state
    GROUP BY d.conv_id, d.n + 1, m.nxt),
plan AS (
    SELECT d.conv_id, min({{'c': d.best.c + e.cost, 'p': d.best.p}}).p AS p
    FROM dp d JOIN ends e ON e.state = d.state JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.n = d.n AND t.n = t.total GROUP BY d.conv_id),
replay AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, p, CAST(0 AS BIGINT) AS k, 0 AS came FROM plan
    UNION ALL
    SELECT r.conv_id, r.n + 1, m.nxt, r.p, CAST(m.k AS BIGINT), r.state
    FROM replay r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.n = r.n + 1
    JOIN moves m ON m.role = t.code AND m.state = r.state AND m.k = TRY_CAST(substr(r.p, CAST(r.n + 1 AS BIGINT), 1) AS INTEGER))
SELECT t.conv_id, t.turn, t.role, m.action, m.new_role, CAST(m.ins + CASE WHEN t.n = t.total THEN e.ins ELSE 0 END AS INTEGER) AS inserted,
    CAST(m.cost + CASE WHEN t.n = t.total THEN e.cost ELSE 0 END AS BIGINT) AS cost, t.n = t.total AS last,
    sha256(m.head || t.text || CASE WHEN t.n = t.total THEN e.tail ELSE '' END) AS piece_sha256
FROM replay r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.n = r.n
JOIN moves m ON m.role = t.code AND m.state = r.came AND m.k = r.k JOIN ends e ON e.state = r.state
"""


ORACLES: dict[str, str] = {
    "op6_repeats": r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
    FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN again USING (h)),
each_word AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM words),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM each_word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
""",
    "op7_chat": _chat_oracle(chat.Costs()),
    "url_rules": f"""
WITH rules(host, path, text, action) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.action}')" for r in URL_RULES)}),
rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
    SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rests),
fits AS (
    SELECT p.page_id, r.text, r.action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.text) DESC, r.text DESC) AS k
    FROM parts p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.text AS rule, f.action FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
""",
    "op4_vectors": r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp ON comp.node = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id
""",
    "op8_warc": r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
q AS (
    SELECT page_id, n, sha1(h) AS d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS head FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
    CASE WHEN head IS NULL OR page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN head IS NULL OR page_id = head THEN NULL ELSE head END AS refers_to
FROM q
""",
    "op3_decontaminate": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN windows v ON p.n = v.n AND p.s = v.s),
hits AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op12_divergence": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
u AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
    SELECT d.lang, d.source, d.term, d.n,
        1 + (CAST(1000000000 AS HUGEINT) * (d.n + 5)) // (CAST(sum(d.n) OVER (PARTITION BY d.lang, d.source) AS HUGEINT) + 5 * v.v) AS p
    FROM dense d JOIN v USING (lang)),
q AS (
    SELECT t.lang, t.term, 1 + (CAST(1000000000 AS HUGEINT) * (t.n + 5)) // (CAST(sum(t.n) OVER (PARTITION BY t.lang) AS HUGEINT) + 5 * v.v) AS q
    FROM (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, term) t JOIN v USING (lang)),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
""",
}
ORACLES["vectors_forest"] = ORACLES["op4_vectors"]

#: CRC-32 of the decimal form of ``c``: over its bytes, and over the eight bits of each, by the polynomial of the checksum.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))))"""
ORACLES["op13_trie"] = f"""
WITH RECURSIVE own AS (
    SELECT conv_id AS c, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS bytes,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, bytes, digest, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) - 1 AS pos FROM own),
sizes AS (SELECT c, n, c - c % 5 AS b, {_CRC} % 9 AS h FROM (SELECT c, CAST(count(*) AS BIGINT) AS n FROM turns GROUP BY c)),
rebuilt AS (
    SELECT s.c, t.pos AS d, t.digest, t.bytes FROM sizes s JOIN turns t ON t.c = s.b WHERE t.pos < s.h
    UNION ALL
    SELECT s.c, t.pos - s.h + least(coalesce(base.n, 0), s.h), t.digest, t.bytes
    FROM sizes s JOIN turns t ON t.c = s.c LEFT JOIN sizes base ON base.c = s.b WHERE t.pos >= s.h),
paths AS (SELECT c, d + 1 AS depth, md5(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d)) AS k, bytes FROM rebuilt),
members AS (
    SELECT c, CAST(0 AS BIGINT) AS depth, 'root' AS k, CAST(NULL AS VARCHAR) AS p, CAST(0 AS BIGINT) AS bytes FROM sizes
    UNION ALL
    SELECT c, depth, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY depth), 'root'), bytes FROM paths),
nodes AS (SELECT k, min(p) AS p, min(depth) AS depth, min(c) AS conv_id, count(*) AS n, min(bytes) AS bytes FROM members GROUP BY k),
kids AS (SELECT p AS k, count(*) AS n_children FROM nodes WHERE p IS NOT NULL GROUP BY p),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, depth) AS k FROM members GROUP BY c) GROUP BY k),
up AS (SELECT k, k AS a FROM nodes UNION ALL SELECT u.k, n.p FROM up u JOIN nodes n ON n.k = u.a WHERE n.p IS NOT NULL),
below AS (
    SELECT a AS k, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n - 1) * bytes) AS saved
    FROM up JOIN nodes USING (k) LEFT JOIN kids USING (k) GROUP BY a)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
    CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes q ON q.k = n.p LEFT JOIN kids x ON x.k = n.k JOIN below w ON w.k = n.k LEFT JOIN ends e ON e.k = n.k
"""
