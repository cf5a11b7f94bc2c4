"""Counts of every stage on a small set of ACGT strings, worked out once from the definition."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators.cluster import labels_of
from threadloom.operators.join import edit_join_exact, edit_join_lsh
from threadloom.params import JoinParams
from threadloom.plans.lsh import buckets, candidate_cardinality, candidate_pairs, collision_counts, collisions
from threadloom.plans.scratch import cut
from threadloom.sources.strings import from_table


@pytest.fixture(scope="module")
def reads(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    acgt = F.substring(F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"), 1, 64)
    return cut(from_table(docs.select("doc_id", acgt.alias("s")), "s", "doc_id"), "reads")


@pytest.mark.parametrize(
    "shift,count_filter,rows,shared,pairs,groups,candidates",
    [(6, 0, 7000, 806, 3447, 205, 205), (6, 1, 7000, 806, 3447, 205, 151), (2, 0, 21000, 4315, 13641, 1416, 372)],
)
def test_stage_counts(reads, shift, count_filter, rows, shared, pairs, groups, candidates):
    p = JoinParams(num_str=5, num_hash=7, num_bits=12, alphabet=4, k=6, shift=shift, sampling_range=91, count_filter=count_filter)
    table = cut(buckets(reads, p), "buckets")
    assert table.count() == rows
    assert candidate_cardinality(table).first()[1:] == (shared, pairs)
    counts = cut(collision_counts(collisions(table, p)), "counts")
    assert counts.count() == groups
    assert candidate_pairs(counts, p).count() == candidates
    assert edit_join_lsh(reads, p, "i", "s").pairs().count() == 24


def test_cluster_counts(reads):
    found = edit_join_exact(reads, 6, "i", "s")
    assert found.pairs().count() == 24
    for min_pts, clusters, noise in ((2, 20, 158), (3, 2, 194)):
        labels = cut(labels_of(reads, found, min_pts), "labels")
        assert (labels.agg(F.max("label")).first()[0], labels.where("label = -1").count()) == (clusters, noise)
