"""The engine's own queries, a stage each, with SQL oracles for DuckDB.

The strings are the addresses of ``pages`` in upper case, all of them and whole: ``i`` counts the pages by id from 0. The random
tables are drawn once on the driver and stand in both plans as the same literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.embed import embed, embedded_column
from threadloom.functions.strings import edit_distance, letter_codes
from threadloom.operators.cluster import cluster, labels_of
from threadloom.operators.consensus import consensus, letters_outside, points_per_cluster
from threadloom.operators.graph import neighbors
from threadloom.operators.join import JoinResult, edit_join_exact, edit_join_lsh, edit_join_tables, lsh_funnel
from threadloom.params import UNREACHED, JoinParams
from threadloom.plans.counting import pair_counts, pair_set
from threadloom.plans.lsh import bucket_sizes, buckets, candidate_cardinality, collisions
from threadloom.plans.numbering import numbered
from threadloom.plans.scratch import cut, scratch_path
from threadloom.sinks.files import sorted_pairs, write_consensus, write_pairs
from threadloom.sources.strings import from_table, is_fastq, read_lines, read_strings

PARAMS = JoinParams(num_str=5, num_hash=7, num_bits=12, alphabet=37, k=4, shift=2, sampling_range=60, count_filter=1, min_pts=3)
#: Rows of a chunk in the two-level query: small, so that the small tables have several.
CHUNKED = JoinParams(num_str=5, num_hash=7, num_bits=12, alphabet=37, k=4, shift=2, sampling_range=60, min_pts=3, chunk_size=100, second_level_min_pts=1)
#: Addresses for each task that embeds them.
TASK_STRINGS = 2048


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.upper("url").alias("s"))
    return from_table(pages, "s", "page_id").where("s is not null")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses are few bytes, which adaptive execution would leave in one task, and 70 rows each: so they are dealt by their number."""
    rows = cut(strings(spark, sf_dir), "rows")
    return buckets(rows.repartition(max(1, -(-rows.count() // TASK_STRINGS))), PARAMS)


def _collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions(cut(_buckets(spark, sf_dir), "buckets"), PARAMS)


def _exact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, JoinResult]:
    rows = cut(strings(spark, sf_dir), "rows")
    return rows, edit_join_exact(rows, PARAMS.k, "i", "s")


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, found = _exact(spark, sf_dir)
    return rows, labels_of(rows, found, PARAMS.min_pts)


def scan_ids(spark, d):
    return strings(spark, d).select("i", "s")


def input_bytes(spark, d):
    return strings(spark, d).agg(F.count("*").alias("n_strings"), F.sum(F.octet_length("s")).cast("long").alias("n_bytes"))


def alphabet_encode(spark, d):
    return strings(spark, d).select("i", F.array_join(letter_codes(F.col("s"), PARAMS.alphabet).cast("array<string>"), ",").alias("codes"))


def cgk_embed(spark, d):
    every = F.array_join("sigs", "|").alias("sigs")
    return embed(strings(spark, d), PARAMS).select("i", "t", "q", every)


def cgk_embed_native(spark, d):
    rows = strings(spark, d)
    # Few bytes, which adaptive execution would leave in one task, but slow to embed: so they are dealt by their number.
    rows = rows.repartition(max(1, -(-rows.count() // TASK_STRINGS)))
    cells = [F.struct(F.lit(t).alias("t"), F.lit(q).alias("q"), embedded_column(F.col("s"), PARAMS, t, q).alias("e")) for t in range(PARAMS.num_str) for q in range(PARAMS.num_rep)]
    sig = F.concat_ws("|", *(F.concat(*(F.substring("e", p + 1, 1) for p in row)) for row in PARAMS.positions))
    return rows.select("i", F.explode(F.array(*cells)).alias("x")).select("i", "x.*").select("i", "t", "q", sig.alias("sigs"))


def lsh_buckets(spark, d):
    return _buckets(spark, d)


def lsh_bucket_sizes(spark, d):
    return bucket_sizes(_buckets(spark, d))


def lsh_candidate_cardinality(spark, d):
    return candidate_cardinality(_buckets(spark, d))


def filtered_candidates(spark, d):
    return _collisions(spark, d).select("i1", "i2", "q1", "q2", "t", "k")


def candidate_freq(spark, d):
    return pair_counts(cut(strings(spark, d), "rows"), PARAMS)


def candidate_pair_set(spark, d):
    return pair_set(cut(strings(spark, d), "rows"), PARAMS)


def lsh_join(spark, d):
    return edit_join_lsh(strings(spark, d), PARAMS, "i", "s").pairs()


def exact_join(spark, d):
    return _exact(spark, d)[1].pairs()


def exact_join_degrees(spark, d):
    return _exact(spark, d)[1].degrees().select(F.col("id"), F.col("i").alias("class_id"), "n_links")


def join_funnel(spark, d):
    return lsh_funnel(strings(spark, d), PARAMS, "i", "s")


def edit_distance_scalar(spark, d):
    """Each address and its plain form (no ``https``, no query, no fragment), and -1 where they differ by more than eight edits."""
    return strings(spark, d).select(F.col("s").alias("a"), _plain(F.col("s")).alias("b")).select("a", "b", edit_distance(F.col("a"), F.col("b"), 8).alias("dist"))


def _plain(s):
    return F.regexp_replace(F.regexp_replace(s, "[?#].*$", ""), "^HTTPS:", "HTTP:")


def tables_join(spark, d):
    """All addresses against all their plain forms: rows of the same table never meet."""
    rows = strings(spark, d)
    return edit_join_tables(rows, rows.select("i", _plain(F.col("s")).alias("s")), PARAMS.k, "i")


def _file(spark, d, name, value):
    """Path of a text file with a line for each string, in their order."""
    path = scratch_path(spark, name)
    strings(spark, d).orderBy("i").select(value).write.text(path)
    return path


def scan_text(spark, d):
    return read_strings(spark, _file(spark, d, "text", F.col("s")))


def _fastq(spark, d):
    """Records of four lines, and one more that is cut off."""
    whole = F.concat(F.lit("@"), F.col("i").cast("string"), F.lit("\n"), F.col("s"), F.lit("\n+\n"), F.repeat(F.lit("!"), F.length("s")))
    rows = strings(spark, d)
    path = scratch_path(spark, "fastq")
    last = rows.agg((F.coalesce(F.max("i"), F.lit(-1)) + 1).alias("i")).select("i", F.lit("@cut\nACGT").alias("value"))
    rows.select("i", whole.alias("value")).unionByName(last).orderBy("i").select("value").write.text(path)
    return path


def scan_fastq(spark, d):
    return read_strings(spark, _fastq(spark, d))


def detect_format(spark, d):
    """Four files, the first and third of them FASTQ: what each is taken for and the strings that it gives."""
    out = None
    for k in range(4):
        record = F.concat(F.lit("@"), F.col("i").cast("string"), F.lit("\n"), F.col("s"), F.lit("\n+\n"), F.repeat(F.lit("!"), F.length("s")))
        path = scratch_path(spark, "mixed")
        strings(spark, d).where(F.col("i") % 4 == k).orderBy("i").select(F.col("s") if k % 2 else record).write.text(path)
        fastq = is_fastq(spark, path)
        found = read_strings(spark, path).agg(F.count("*").alias("n_strings"), F.coalesce(F.sum(F.length("s")), F.lit(0)).cast("long").alias("n_letters"))
        found = found.select(F.lit(k).alias("file"), F.lit(fastq).alias("fastq"), "n_strings", "n_letters")
        out = found if out is None else out.unionByName(found)
    return out


#: Threshold of the join of short strings: a third of their letters.
SHORT_K = 20


def short_strings(spark, d):
    """Sixty letters of ACGT for each page: 30 from the digest of its host and 30 from that of its address, so pages of a host are near."""
    host = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)
    letters = [F.translate(F.substring(F.md5(F.encode(c, "UTF-8")), 1, 30), "0123456789abcdef", "ACGT" * 4) for c in (host, F.col("url"))]
    pages = spark.read.parquet(f"{d}/pages.parquet").where("url is not null")
    return from_table(pages.select("page_id", F.concat(*letters).alias("s")), "s", "page_id")


def short_join(spark, d):
    """How near the pages are to others, by strings that are short for the threshold."""
    return edit_join_exact(short_strings(spark, d), SHORT_K, "i", "s").near().select("id", "n_links", "n_others", "nearest", "sum_dist")


#: Bits of each of the five columns to sort.
SORT_BITS = 28


def five_columns(rows, *keys):
    """Five columns of 28 bits for each row, from the digests of its keys."""
    text = F.concat_ws("-", *(F.col(k).cast("string") for k in keys))
    digest = F.concat(*(F.md5(F.encode(F.concat(text, F.lit(x)), "UTF-8")) for x in "ab"))
    return rows.select(*(F.conv(F.substring(digest, 1 + 7 * k, 7), 16, 10).cast("long").alias(c) for k, c in enumerate("abcde")))


def packed(rows):
    """The columns of a row in two numbers and a last one, whose order is that of the columns: a sort then compares few rows by more than one number."""
    two = lambda x, y: F.shiftleft(F.col(x), SORT_BITS).bitwiseOR(F.col(y))
    return rows.select(two("a", "b").alias("ab"), two("c", "d").alias("cd"), F.col("e").cast("int").alias("e"))


def unpacked(rows, *more):
    low = F.lit((1 << SORT_BITS) - 1)
    columns = [x for c in ("ab", "cd") for x in (F.shiftright(c, SORT_BITS).alias(c[0]), F.col(c).bitwiseAND(low).alias(c[1]))]
    return rows.select(*more, *columns, F.col("e").cast("long").alias("e"))


def sorted_rows(spark, d):
    """Every line item as five columns, with its place in the order of all of them."""
    rows = five_columns(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_linenumber", "l_partkey")
    return unpacked(numbered(packed(rows), "ab", "cd", "e", name="place"), "place")


def pair_sink(spark, d):
    rows, found = _exact(spark, d)
    path = scratch_path(spark, "pairs")
    write_pairs(found.pairs(), rows, path)
    return read_lines(spark, path).select(F.col("i").alias("line"), F.col("s").alias("value"))


def unique_pairs(spark, d):
    """Pairs written in order, each once, read back with their places."""
    path = scratch_path(spark, "sorted")
    sorted_pairs(_exact(spark, d)[1].pairs()).select(F.concat_ws(" ", "id1", "id2")).write.text(path)
    return read_lines(spark, path).select(F.col("i").alias("place"), F.col("s").alias("pair"))


def consensus_sink(spark, d):
    path = scratch_path(spark, "consensus")
    write_consensus(cluster_consensus(spark, d), path)
    return read_lines(spark, path).select(F.col("i").alias("line"), F.col("s").alias("value"))


def alphabet_guard(spark, d):
    """Clusters of addresses, the letters in them that are not of the plain alphabet, and how often these stand there."""
    rows, labels = _labels(spark, d)
    return letters_outside(rows.join(labels, "i"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def graph_neighbors(spark, d):
    return neighbors(_exact(spark, d)[1].pairs(), "id1", "id2")


def graph_degrees(spark, d):
    degree = (F.col("n_links") + 1).alias("degree")
    return _exact(spark, d)[1].degrees().select(F.col("id").alias("i"), degree)


def graph_core_points(spark, d):
    return graph_degrees(spark, d).where(F.col("degree") >= PARAMS.min_pts).select("i")


def dbscan_labels(spark, d):
    return _labels(spark, d)[1]


def cluster_points(spark, d):
    return points_per_cluster(_labels(spark, d)[1])


def cluster_consensus(spark, d):
    rows, labels = _labels(spark, d)
    return consensus(rows.join(labels, "i"))


def two_level_cluster(spark, d):
    return cluster(cut(strings(spark, d), "rows"), CHUNKED, exact=True)


QUERIES = {
    "scan_ids": scan_ids,
    "input_bytes": input_bytes,
    "alphabet_encode": alphabet_encode,
    "cgk_embed": cgk_embed,
    "cgk_embed_native": cgk_embed_native,
    "lsh_buckets": lsh_buckets,
    "bucket_sizes": lsh_bucket_sizes,
    "candidate_cardinality": lsh_candidate_cardinality,
    "filtered_candidates": filtered_candidates,
    "candidate_freq": candidate_freq,
    "candidate_pairs": candidate_pair_set,
    "edit_join_lsh": lsh_join,
    "edit_join_exact": exact_join,
    "edit_join_degrees": exact_join_degrees,
    "join_funnel": join_funnel,
    "edit_distance_scalar": edit_distance_scalar,
    "neighbors": graph_neighbors,
    "degree": graph_degrees,
    "core_points": graph_core_points,
    "dbscan_labels": dbscan_labels,
    "points_per_cluster": cluster_points,
    "consensus": cluster_consensus,
    "two_level_cluster": two_level_cluster,
    "edit_join_tables": tables_join,
    "scan_text": scan_text,
    "scan_fastq": scan_fastq,
    "detect_format": detect_format,
    "edit_join_short": short_join,
    "sorted_rows": sorted_rows,
    "pair_sink": pair_sink,
    "unique_pairs": unique_pairs,
    "consensus_sink": consensus_sink,
    "alphabet_guard": alphabet_guard,
}


def _array(x) -> str:
    return "[" + ",".join(_array(y) for y in x) + "]" if isinstance(x, list) else str(x)


def _level(n: int, k: int, min_pts: int, rows: str) -> str:
    """Clusters (``found``) of the rows (i, s, chunk, reads) that a query gives, by the rules of ``cluster``; names end in the level."""
    return f"""rows{n} AS ({rows}),
edges{n} AS (
    SELECT a.i AS src, b.i AS dst FROM rows{n} a JOIN rows{n} b ON a.chunk = b.chunk AND a.i <> b.i AND abs(length(a.s) - length(b.s)) <= {k} WHERE levenshtein(a.s, b.s) <= {k}),
core{n} AS (SELECT i FROM rows{n} LEFT JOIN edges{n} ON i = src GROUP BY i HAVING count(dst) + 1 >= {min_pts}),
reach{n} AS (
    SELECT i AS node, i AS other FROM core{n}
    UNION
    SELECT r.node, e.dst FROM reach{n} r JOIN edges{n} e ON e.src = r.other JOIN core{n} c ON c.i = e.dst),
numbers{n} AS (SELECT node, dense_rank() OVER (ORDER BY root) AS label FROM (SELECT node, min(other) AS root FROM reach{n} GROUP BY node)),
border{n} AS (SELECT e.dst AS i, min(x.label) AS label FROM edges{n} e JOIN numbers{n} x ON x.node = e.src GROUP BY e.dst),
labels{n} AS (SELECT r.i, r.s, r.reads, coalesce(x.label, b.label) AS label FROM rows{n} r LEFT JOIN numbers{n} x ON x.node = r.i LEFT JOIN border{n} b ON b.i = r.i),
letters{n} AS (
    SELECT label, unnest(range(1, length(s) + 1)) AS pos, unnest(string_split(s, '')) AS ch FROM labels{n} WHERE label IS NOT NULL),
best{n} AS (
    SELECT label, pos, ch FROM (
        SELECT label, pos, ch, row_number() OVER (PARTITION BY label, pos ORDER BY count(*) DESC, ch) AS r
        FROM letters{n} WHERE pos <= (SELECT width FROM counts) GROUP BY label, pos, ch) WHERE r = 1),
found{n} AS (
    SELECT p.label, coalesce(string_agg(ch, '' ORDER BY pos), '') AS consensus, any_value(points) AS points, any_value(reads) AS reads
    FROM (SELECT label, count(*) AS points, sum(reads) AS reads FROM labels{n} WHERE label IS NOT NULL GROUP BY label) p LEFT JOIN best{n} b ON b.label = p.label GROUP BY p.label)"""


def _two_levels(base: str, p: JoinParams) -> str:
    counted = f"counted AS (SELECT row_number() OVER (ORDER BY i) - 1 AS i, s FROM strings WHERE s IS NOT NULL), counts AS (SELECT count(*) AS n, any_value(length(s)) FILTER (WHERE i = 0) AS width FROM counted)"
    one = _level(1, p.k, p.min_pts, f"SELECT i, s, CASE WHEN n > {p.chunk_size} THEN i // {p.chunk_size} ELSE 0 END AS chunk, 1 AS reads FROM counted, counts")
    two = _level(2, p.k, p.second_level_min_pts or p.min_pts, "SELECT row_number() OVER (ORDER BY label) - 1 AS i, consensus AS s, 0 AS chunk, reads FROM found1")
    return f"""WITH RECURSIVE {base}, {counted}, {one}, {two}
SELECT CAST(label AS INTEGER) AS label, consensus, CAST(points AS BIGINT) AS points, CAST(reads AS BIGINT) AS reads FROM (
    SELECT f.* FROM found1 f, counts WHERE n <= {p.chunk_size} UNION ALL SELECT f.* FROM found2 f, counts WHERE n > {p.chunk_size})"""


def _oracles(p: JoinParams) -> dict[str, str]:
    base = "strings AS (SELECT CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS i, upper(url) AS s FROM pages)"
    rows = "rows AS (SELECT i, s FROM strings WHERE s IS NOT NULL)"
    code = f"greatest(instr('{p.letters}', substr(s, x + 1, 1)) - 1, 0)"
    size = p.last_position + 1
    embedding = f"""
walks AS (SELECT CAST({_array(p.walks)} AS INTEGER[][][]) AS w),
cells AS (SELECT CAST(tt.t AS INTEGER) AS t, CAST(qq.q AS INTEGER) AS q FROM range({p.num_str}) tt(t), range({p.num_rep}) qq(q)),
walk AS (
    SELECT i, s, t, q, CAST(q * {p.shift} AS BIGINT) AS x, CAST(0 AS BIGINT) AS j,
        CASE WHEN length(s) > q * {p.shift} THEN (SELECT w FROM walks)[t + 1][{code.replace('x + 1', f'q * {p.shift} + 1')} + 1][1] END AS run
    FROM rows, cells WHERE length(s) > q * {p.shift}
    UNION ALL
    SELECT i, s, t, q, x, j, (SELECT w FROM walks)[t + 1][{code} + 1][j + 1] FROM (
        SELECT i, s, t, q, x + 1 AS x, j + run + 1 AS j FROM walk WHERE x + 1 < length(s) AND j + run + 1 < {size})),
spots AS (
    SELECT CAST(k.generate_subscripts - 1 AS INTEGER) AS k, CAST(u.generate_subscripts - 1 AS INTEGER) AS u,
        CAST({_array(p.positions)} AS INTEGER[][])[k.generate_subscripts][u.generate_subscripts] AS pos
    FROM range(1, {p.num_hash + 1}) k(generate_subscripts), range(1, {p.num_bits + 1}) u(generate_subscripts)),
places AS (SELECT i, t, q, unnest(range(j, least(j + run + 1, {size}))) AS pos, substr(s, x + 1, 1) AS ch FROM walk),
chars AS (
    SELECT r.i, c.t, c.q, length(r.s) AS n, o.k, o.u, coalesce(l.ch, '{UNREACHED}') AS ch
    FROM rows r CROSS JOIN cells c CROSS JOIN spots o LEFT JOIN places l ON l.i = r.i AND l.t = c.t AND l.q = c.q AND l.pos = o.pos),
table_ AS (
    SELECT t, k, i, q, CAST(any_value(n) AS INTEGER) AS n, string_agg(ch, '' ORDER BY u) AS sig,
        CAST(sum(greatest(instr('{p.letters}', ch) - 1, 0) * CAST({_array(p.weights)} AS BIGINT[])[u + 1]) % {p.hash_size} AS BIGINT) AS hash_id
    FROM chars GROUP BY t, k, i, q)"""
    agree = f"len(list_filter(range(1, {p.num_bits + 1}), lambda u: a.sig[u] <> b.sig[u] AND a.sig[u] <> '{UNREACHED}' AND b.sig[u] <> '{UNREACHED}')) = 0"
    hits = f"""
hits AS (
    SELECT a.i AS i1, b.i AS i2, a.q AS q1, b.q AS q2, a.t, a.k FROM table_ a JOIN table_ b ON a.t = b.t AND a.k = b.k AND a.hash_id = b.hash_id
    WHERE a.i < b.i AND abs(a.n - b.n) <= {p.k} AND {agree}),
freq AS (SELECT i1, i2, q1, q2, count(*) AS freq FROM hits GROUP BY ALL),
cand AS (SELECT DISTINCT i1, i2 FROM freq WHERE freq > {p.count_filter})"""
    exact = f"pairs AS (SELECT a.i AS id1, b.i AS id2, CAST(levenshtein(a.s, b.s) AS INTEGER) AS dist FROM rows a JOIN rows b ON a.i < b.i AND abs(length(a.s) - length(b.s)) <= {p.k} WHERE levenshtein(a.s, b.s) <= {p.k})"
    graph = f"""edges AS (SELECT id1 AS src, id2 AS dst FROM pairs UNION ALL SELECT id2, id1 FROM pairs),
degs AS (SELECT i, CAST(count(dst) + 1 AS BIGINT) AS degree FROM rows LEFT JOIN edges ON i = src GROUP BY i),
core AS (SELECT i FROM degs WHERE degree >= {p.min_pts}),
reach AS (
    SELECT i AS node, i AS other FROM core
    UNION
    SELECT r.node, e.dst FROM reach r JOIN edges e ON e.src = r.other JOIN core c ON c.i = e.dst),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
numbers AS (SELECT node, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label FROM roots),
border AS (SELECT e.dst AS i, min(n.label) AS label FROM edges e JOIN numbers n ON n.node = e.src GROUP BY e.dst),
labels AS (SELECT r.i, CAST(coalesce(n.label, b.label, -1) AS INTEGER) AS label FROM rows r LEFT JOIN numbers n ON n.node = r.i LEFT JOIN border b ON b.i = r.i)"""
    a, b, c, d = (f"WITH RECURSIVE {x}" for x in (f"{base}, {rows}", f"{base}, {rows}, {embedding}", f"{base}, {rows}, {embedding}, {hits}", f"{base}, {rows}, {exact}, {graph}"))
    consensus = """, letters AS (
    SELECT label, unnest(range(1, length(s) + 1)) AS pos, unnest(string_split(s, '')) AS ch FROM labels JOIN rows USING (i) WHERE label <> -1),
best AS (
    SELECT label, pos, ch FROM (
        SELECT label, pos, ch, row_number() OVER (PARTITION BY label, pos ORDER BY count(*) DESC, ch) AS r FROM letters GROUP BY label, pos, ch) WHERE r = 1),
found AS (
    SELECT p.label, coalesce(string_agg(ch, '' ORDER BY pos), '') AS consensus, any_value(points) AS points
    FROM (SELECT label, count(*) AS points FROM labels WHERE label <> -1 GROUP BY label) p LEFT JOIN best b ON b.label = p.label GROUP BY p.label)"""
    return {
        "edit_join_tables": f"""{a}, plain AS (SELECT i, regexp_replace(regexp_replace(s, '[?#].*$', ''), '^HTTPS:', 'HTTP:') AS s FROM rows)
SELECT a.i AS id1, b.i AS id2, CAST(levenshtein(a.s, b.s) AS INTEGER) AS dist FROM rows a JOIN plain b ON abs(length(a.s) - length(b.s)) <= {p.k} WHERE levenshtein(a.s, b.s) <= {p.k}""",
        "scan_text": f"{a} SELECT i, s FROM rows",
        "scan_fastq": f"{a} SELECT i, s FROM rows",
        "detect_format": f"""{a}
SELECT CAST(k AS INTEGER) AS file, k % 2 = 0 AS fastq, count(i) AS n_strings, CAST(coalesce(sum(length(s)), 0) AS BIGINT) AS n_letters
FROM range(4) f(k) LEFT JOIN rows ON i % 4 = k GROUP BY k""",
        "edit_join_short": f"""WITH strings AS (
    SELECT CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS i,
        translate(substr(md5(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), 1, 30) || substr(md5(url), 1, 30), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s
    FROM pages WHERE url IS NOT NULL),
reps AS (SELECT s, min(i) AS i, count(*) AS n FROM strings GROUP BY s),
near AS (
    SELECT i, count(*) AS n_others, sum(n) AS m, min(dist) AS nearest, sum(dist) AS sum_dist
    FROM (SELECT a.i, b.n, levenshtein(a.s, b.s) AS dist FROM reps a JOIN reps b ON a.i <> b.i) WHERE dist <= {SHORT_K} GROUP BY i)
SELECT t.i AS id, CAST(r.n - 1 + coalesce(m, 0) AS BIGINT) AS n_links, coalesce(n_others, 0) AS n_others,
    CAST(nearest AS INTEGER) AS nearest, CAST(sum_dist AS BIGINT) AS sum_dist
FROM strings t JOIN reps r USING (s) LEFT JOIN near n ON n.i = r.i""",
        "sorted_rows": """WITH digests AS (
    SELECT md5(k || 'a') || md5(k || 'b') AS h FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem)),
columns_ AS (SELECT """ + ", ".join(f"CAST('0x' || substr(h, {1 + 7 * k}, 7) AS BIGINT) AS {c}" for k, c in enumerate("abcde")) + """ FROM digests)
SELECT CAST(row_number() OVER (ORDER BY a, b, c, d, e) - 1 AS BIGINT) AS place, a, b, c, d, e FROM columns_""",
        "pair_sink": f"""{d}, numbered AS (SELECT row_number() OVER (ORDER BY id1, id2) - 1 AS n, id1, id2 FROM pairs)
SELECT CAST(3 * n + k AS BIGINT) AS line, CASE k WHEN 0 THEN id1 || ' ' || id2 WHEN 1 THEN x.s ELSE y.s END AS value
FROM numbered JOIN rows x ON x.i = id1 JOIN rows y ON y.i = id2, range(3) r(k)""",
        "unique_pairs": f"{d} SELECT CAST(row_number() OVER (ORDER BY id1, id2) - 1 AS BIGINT) AS place, id1 || ' ' || id2 AS pair FROM pairs",
        "consensus_sink": f"{d}{consensus} SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS line, consensus || ' ' || points AS value FROM found",
        "alphabet_guard": f"""{d}, letters AS (SELECT label, unnest(string_split(s, '')) AS ch FROM labels JOIN rows USING (i) WHERE label <> -1)
SELECT label, ch, count(*) AS n FROM letters WHERE NOT regexp_matches(ch, '^[A-Z]$') GROUP BY label, ch""",
        "two_level_cluster": _two_levels(base, CHUNKED),
        "scan_ids": f"{a} SELECT i, s FROM rows",
        "input_bytes": f"{a} SELECT count(*) AS n_strings, CAST(sum(octet_length(encode(s))) AS BIGINT) AS n_bytes FROM rows",
        "alphabet_encode": f"{a} SELECT i, coalesce(array_to_string(list_transform(range(length(s)), lambda x: CAST({code} AS VARCHAR)), ','), '') AS codes FROM rows",
        "cgk_embed": f"{b} SELECT i, t, q, string_agg(sig, '|' ORDER BY k) AS sigs FROM table_ GROUP BY i, t, q",
        "cgk_embed_native": f"{b} SELECT i, t, q, string_agg(sig, '|' ORDER BY k) AS sigs FROM table_ GROUP BY i, t, q",
        "lsh_buckets": f"{b} SELECT t, k, hash_id, i, q, n, sig FROM table_",
        "bucket_sizes": f"{b} SELECT t, k, hash_id, count(*) AS size FROM table_ GROUP BY ALL",
        "candidate_cardinality": f"{b} SELECT count(*) AS n_buckets, count(*) FILTER (WHERE size > 1) AS n_shared, CAST(sum(size * (size - 1)) / 2 AS BIGINT) AS n_pairs FROM (SELECT count(*) AS size FROM table_ GROUP BY t, k, hash_id)",
        "filtered_candidates": f"{c} SELECT * FROM hits",
        "candidate_freq": f"{c} SELECT * FROM freq",
        "candidate_pairs": f"{c} SELECT * FROM cand",
        "edit_join_lsh": f"{c} SELECT i1 AS id1, i2 AS id2, CAST(levenshtein(a.s, b.s) AS INTEGER) AS dist FROM cand JOIN rows a ON a.i = i1 JOIN rows b ON b.i = i2 WHERE levenshtein(a.s, b.s) <= {p.k}",
        "edit_join_exact": f"{d} SELECT * FROM pairs",
        "edit_join_degrees": f"{d} SELECT g.i AS id, min(g.i) OVER (PARTITION BY s) AS class_id, degree - 1 AS n_links FROM degs g JOIN rows r ON r.i = g.i",
        "join_funnel": f"{c}, firsts AS (SELECT min(i) AS i FROM rows GROUP BY s), verified AS (SELECT a.s AS s1, b.s AS s2 FROM cand JOIN firsts f ON f.i = i1 JOIN firsts g ON g.i = i2 JOIN rows a ON a.i = i1 JOIN rows b ON b.i = i2) SELECT count(*) AS n_candidates, count(*) FILTER (WHERE levenshtein(s1, s2) <= {p.k}) AS n_links FROM verified",
        "edit_distance_scalar": f"""{a}, both_ AS (SELECT s AS a, regexp_replace(regexp_replace(s, '[?#].*$', ''), '^HTTPS:', 'HTTP:') AS b FROM rows)
SELECT a, b, CAST(CASE WHEN levenshtein(a, b) <= 8 THEN levenshtein(a, b) ELSE -1 END AS INTEGER) AS dist FROM both_""",
        "neighbors": f"{d} SELECT src, dst FROM edges",
        "degree": f"{d} SELECT i, degree FROM degs",
        "core_points": f"{d} SELECT i FROM core",
        "dbscan_labels": f"{d} SELECT i, label FROM labels",
        "points_per_cluster": f"{d} SELECT label, count(*) AS points FROM labels WHERE label <> -1 GROUP BY label",
        "consensus": f"{d}{consensus} SELECT label, consensus, points FROM found",
    }


ORACLES = _oracles(PARAMS)
