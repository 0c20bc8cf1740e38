import hashlib
import re

import pytest
from pyspark.sql import functions as F

from elevspark.llm.common import text_of
from elevspark.llm.exact_dedup import block_names, exact_dedup, groups, identities, squeezed

SCHEMA = "doc_id long, text string, lang string, n string"


def rows():
    long = "abc de" * 50
    return [
        (1, "ab c", "x", "a"), (2, "a bc", "x", "b"), (3, "abc  ", None, "c"), (4, None, "x", "d"), (5, "", "x", "e"), (6, " \t\n\x0b\f\r", "x", "f"),
        (7, long, "x", "g"), (8, long + " ", "x", "h"), (9, long[:-1], "x", "i"), (10, long + long, "x", "j"), (11, "é" * 33, "x", "k"), (12, "é" * 33, "x", "l"),
        (None, "abc", "x", "m"), (13, "\x1cab c", "x", "n"), (14, "abcd", "x", "o"), (14, "abcd", "x", "o"), (15, "x" * 16 + "y" * 16, "x", "p"), (16, "y" * 16 + "x" * 16, "x", "q"),
    ]


def brute(data):
    by = {}
    for i, r in enumerate(data):
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = []
    for t, g in by.items():
        best = max(g, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))
        out += [(r[0], best[0], len(g), hashlib.sha256(t.encode()).hexdigest()) for r in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [F.xxhash64, lambda b: F.pmod(F.xxhash64(b), F.lit(3)), lambda b: F.length(b).cast("long")])
@pytest.mark.parametrize("block", [4, 4096])
def test_groups_match_brute_force_even_with_clashing_digests(spark, digest, block):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = groups(identities(df, block, digest))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out.collect()), key=str)
    assert got == brute(rows())
    assert out.where("rid = keep_rid").count() == len({x[3] for x in got})


def test_kept_rows_carry_their_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = exact_dedup(df)
    assert kept.columns == df.columns
    assert kept.count() == len({x[3] for x in brute(rows())})
    assert exact_dedup(df.where("false")).count() == 0


@pytest.mark.parametrize("digest", [F.xxhash64, lambda b: F.pmod(F.xxhash64(b), F.lit(3))])
def test_names_are_places_in_sorted_order_on_any_number_of_partitions(spark, digest):
    df = spark.createDataFrame(rows(), SCHEMA)
    found = []
    for n in ("3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            names, clashes = block_names(df.select(squeezed(text_of()).alias("t")), digest, 4)
            by = {(r.h, ""): r.name for r in names.collect()} | ({(r.h, r.block): r.name for r in clashes.collect()} if clashes is not None else {})
            ids = {(r.doc_id, r.text_sha256, r.level, r.name) for r in identities(df, 4, digest).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert [by[k] for k in sorted(by)] == list(range(len(by)))
        found.append((by, ids))
    assert found[0] == found[1]
