"""Digests of tables: independent of the split, one changed row changes one branch or two."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import snapshot

KIND = "i long, t string, s string"


def branches(df):
    return snapshot.branch_digests(df, F.col("s"), [F.col("i"), F.col("t")], F.length("t"))


def rows_of(n=500):
    rng = random.Random(2)
    return [(i, rng.choice(["a", "b" * 9, "", None]), rng.choice(["x", "y", None])) for i in range(n)]


def test_split_and_order_do_not_matter(spark):
    rows = rows_of()
    one = snapshot.manifest_snapshot(branches(spark.createDataFrame(rows, KIND).coalesce(1)))
    shuffled = random.Random(1).sample(rows, len(rows))
    other = snapshot.manifest_snapshot(branches(spark.createDataFrame(shuffled, KIND).repartition(13)))
    assert sorted(one.collect()) == sorted(other.collect())
    found = {r.shard: (r["rows"], r.size) for r in one.collect()}
    for shard in ("x", "y", ""):
        own = [r for r in rows if (r[2] or "") == shard]
        assert found[shard] == (len(own), sum(len(r[1] or "") for r in own))
    assert one.select("snapshot_id").distinct().count() == 1


def test_one_changed_row_changes_its_branches_only(spark):
    rows = rows_of()
    changed = [(i, "new text" if i == 77 else t, s) for i, t, s in rows]
    before, after = (branches(spark.createDataFrame(r, KIND)) for r in (rows, changed))
    found = snapshot.changed_branches(before, after).collect()
    assert 1 <= len(found) <= 2 and {r.shard for r in found} == {rows[77][2] or ""}
    assert sum(r.rows_before for r in found) == sum(r.rows_after for r in found)
    digests = [{r.shard: r.digest for r in snapshot.manifest_snapshot(b).collect()} for b in (before, after)]
    assert [k for k in digests[0] if digests[0][k] != digests[1][k]] == [rows[77][2] or ""]
    assert snapshot.changed_branches(before, before).collect() == []


def test_repeats_and_nulls_count(spark):
    ids = set()
    for rows in ([(1, "a", "x")], [(1, "a", "x")] * 2, [(1, None, "x")], [(None, "a", "x")], [(1, "", "x")], [(1, "-", "x")], [(11, "a", "x")]):
        ids.add(snapshot.manifest_snapshot(branches(spark.createDataFrame(rows, KIND))).first().snapshot_id)
    assert len(ids) == 7
    assert snapshot.manifest_snapshot(branches(spark.createDataFrame([], KIND))).collect() == []
