import random

import pytest

from threadloom.__main__ import main
from threadloom.operators.join import edit_join_exact, edit_join_lsh
from threadloom.params import JoinParams
from threadloom.sinks.files import Report, sorted_pairs, write_consensus, write_pairs
from threadloom.sources import records
from threadloom.sources.strings import from_table, is_fastq, read_lines, read_records, read_strings
from threadloom.streaming import selfjoin
from threadloom.streaming.join import match_stream


def rows(df):
    return sorted((r.i, r.s) for r in df.collect())


def test_lines_keep_blank_ones_and_carriage_returns(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\nthree\r\nfour")
    assert rows(read_strings(spark, str(tmp_path / "a.txt"))) == [(0, "one\r"), (1, ""), (2, "three\r"), (3, "four")]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {k} {'x' * (k % 37)}" for k in range(5000)]
    (tmp_path / "b.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_lines(spark, str(tmp_path / "b.txt"))
        assert got.rdd.getNumPartitions() > 3
        assert rows(got) == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_drops_incomplete_records(spark, tmp_path):
    (tmp_path / "c.fq").write_text("@a\nACGT\n+\n!!!!\n@b\nGG\n+\n##\n@c\nTT\n")
    assert is_fastq(spark, str(tmp_path / "c.fq"))
    assert rows(read_strings(spark, str(tmp_path / "c.fq"))) == [(0, "ACGT"), (1, "GG")]


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("")
    assert rows(read_strings(spark, str(tmp_path / "d.txt"))) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_strings(spark, str(tmp_path / "none.txt"))


def test_table_source_and_sinks(spark, tmp_path):
    table = spark.createDataFrame([(30, "ACGA"), (10, "ACGT"), (20, "TTTT")], "k long, v string")
    strings = from_table(table, "v", "k")
    assert rows(strings) == [(0, "ACGT"), (1, "TTTT"), (2, "ACGA")]
    pairs = edit_join_exact(strings, 1, "i", "s").pairs()
    assert [tuple(r) for r in sorted_pairs(pairs).collect()] == [(0, 2)]
    write_pairs(pairs, strings, str(tmp_path / "pairs"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "pairs").glob("part*"))) == "0 2\nACGT\nACGA\n"
    write_consensus(spark.createDataFrame([(1, "ACG", 4)], "label int, consensus string, points long"), str(tmp_path / "cons"))
    assert "".join(p.read_text() for p in (tmp_path / "cons").glob("part*")) == "ACG 4\n"
    report = Report()
    with report.step("join", "verify"):
        pass
    with pytest.raises(ValueError), report.step("join", "fails"):
        raise ValueError
    assert [r[1] for r in report.rows] == ["verify", "fails"]
    report.write(spark, str(tmp_path / "report"))
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part*"))
    assert text.startswith("MainStep,Step,SubStep,Time(sec),Device\njoin,verify,")


@pytest.mark.parametrize("alg,folder", [("1", "join_output"), ("2", "consensus_results")])
def test_command_line(spark, tmp_path, capsys, alg, folder):
    (tmp_path / "reads.txt").write_text("\n".join(["ACGTACGTAC", "ACGTACGTAA", "ACGTACGTAC", "TTTTTTTTTT"]))
    main(["-a", alg, "-r", str(tmp_path / "reads.txt"), "-d", "0", "-s", "20", "-c", "0", "-b", "500", "-p", "3", "--k", "2", "--shift", "2", "--exact", "-o", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert ("pairs: 3" if alg == "1" else "clusters: 1") in said
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / folder).glob("part*")))
    assert text.splitlines()[0] == ("0 1" if alg == "1" else "ACGTACGTAC 3")


def test_stream_meets_table(spark, tmp_path):
    p = JoinParams(num_str=4, num_hash=6, num_bits=4, alphabet=4, k=2, shift=2, sampling_range=12)
    static = spark.createDataFrame([(0, "ACGTACGTAC"), (1, "TTTTTTTT"), (2, None)], "i long, s string")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(7, "ACGTACGTAA"), (8, "GGGGGGGG"), (9, "TTTTTTTT")], "id long, s string").write.parquet(str(tmp_path / "in" / "x"))
    stream = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in" / "*"))
    got = []
    match_stream(stream, static, p, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(got) == [(7, 0, 1), (9, 1, 0)]


def fastq(n, seed=3, cut=""):
    """Records whose qualities may begin with ``@`` or ``+`` and whose headers may look like anything else."""
    rng = random.Random(seed)
    out, seqs = [], []
    for k in range(n):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40)))
        seqs.append(s)
        out.append(f"@{rng.choice(['r', '@', '+'])}{k}\n{s}\n+{rng.choice(['', 'x'])}\n{rng.choice(['@', '+', '!'])[: len(s)]}{'#' * max(0, len(s) - 1)}\n")
    return "".join(out) + cut, seqs


@pytest.mark.parametrize("size,end", [(2, "\n"), (37, ""), (200, "\n\n"), (1 << 20, "\n")])
def test_records_of_any_splits(spark, tmp_path, size, end):
    lines = [f"line {k} {'é' * (k % 7)}\r" if k % 5 else "" for k in range(min(300, 4 * size))]
    (tmp_path / "a.txt").write_text("\n".join(lines) + end, newline="")
    want = ("\n".join(lines) + end).split("\n")
    got = read_records(spark, str(tmp_path / "a.txt"), size)
    assert rows(got) == list(enumerate(want[:-1] if want[-1] == "" else want))
    text, seqs = fastq(min(90, 2 * size), cut="@last\nACGT\n+\n")
    (tmp_path / "b.fq").write_text(text)
    assert rows(read_records(spark, str(tmp_path / "b.fq"), size)) == list(enumerate(seqs))


def test_lines_are_not_moved(spark, tmp_path):
    """No plan has an exchange of lines: neither the source nor Spark's own reader with numbers."""
    (tmp_path / "a.txt").write_text("\n".join(map(str, range(2000))))
    plans = [f(spark, str(tmp_path / "a.txt"))._jdf.queryExecution().executedPlan().toString() for f in (read_records, read_lines)]
    assert not any("Exchange hashpartitioning" in p or "SortMergeJoin" in p or "rangepartitioning" in p for p in plans)


def test_a_folder_and_odd_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 16)
    (tmp_path / "in").mkdir()
    for name, data in (("part-1", b"b\n\xff\xfe x\n" + b"long " * 60 + b"\nend"), ("part-0", b"a\n"), ("part-2", b""), ("_SUCCESS", b"no"), (".x", b"no")):
        (tmp_path / "in" / name).write_bytes(data)
    spark.dataSource.register(records.StringsSource)
    got = spark.read.format("threadloom_strings").load(str(tmp_path / "in"))
    assert rows(got) == [(0, "a"), (1, "b"), (2, "�� x"), (3, "long " * 60), (4, "end")] == rows(read_records(spark, str(tmp_path / "in"), 9))
    with pytest.raises(Exception, match="none.txt"):
        spark.read.format("threadloom_strings").load(str(tmp_path / "none.txt")).count()


def test_stream_of_files(spark, tmp_path):
    """Each file once, in any splits, also after a restart; a record belongs to the split that it begins in."""
    spark.dataSource.register(records.StringsSource)
    (tmp_path / "in").mkdir()
    got = []

    def run():
        stream = spark.readStream.format("threadloom_strings").option("splitBytes", 61).load(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination(120)

    text, seqs = fastq(60, cut="@cut\nAC")
    (tmp_path / "in" / "a.fq").write_text(text)
    run()
    assert [s for _, s in sorted(got)] == seqs and len({i for i, _ in got}) == len(seqs)
    (tmp_path / "in" / "b.txt").write_text("one\n\ntwo")
    run()
    assert [s for _, s in sorted(got)] == seqs + ["one", "", "two"]


def test_stream_meets_itself(spark, tmp_path):
    """Pairs within a batch and across batches, also across a restart; each once, and those that a join of all strings finds."""
    p = JoinParams(num_str=3, num_hash=4, num_bits=4, alphabet=4, k=2, shift=2, sampling_range=12)
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(14)) for _ in range(5)]
    texts = [s[: k % 14] + rng.choice("ACGT") + s[k % 14 + 1 :] for k, s in enumerate(base * 4)] + [base[0], None]
    spark.conf.set(*selfjoin.STORE)
    (tmp_path / "in").mkdir()
    got = []

    def run(part, rows):
        spark.createDataFrame(rows, "id long, s string").coalesce(1).write.parquet(str(tmp_path / "in" / part))
        stream = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in" / "*"))
        selfjoin.match_within(stream, p, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "cp")).awaitTermination(200)

    rows = list(enumerate(texts))
    try:
        run("one", rows[:9])
        first = len(got)
        run("two", rows[9:])
    finally:
        spark.conf.unset(selfjoin.STORE[0])
    whole = edit_join_lsh(spark.createDataFrame(rows, "i long, s string"), p, "i", "s", plan="buckets").pairs().collect()
    assert sorted(got) == sorted(tuple(r) for r in whole) and 0 < first < len(got)
