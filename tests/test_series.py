"""Segments, exact quantiles and repeated series against brute force, with hot keys over many blocks."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ordered, quantiles, series
from tallyforge.streaming import stream_files, stream_sessions

ZERO = datetime(2024, 1, 1)
KIND = "i long, k string, ts timestamp, v double"


@pytest.fixture
def many_blocks(spark):
    """Rows are few here; without this they would be put into one block."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(n=3000, seed=1):
    """Two thirds belong to one key, some to the null key; times repeat and some values are missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else rng.choice(["a", "b", None, "few"] if i < 300 else ["a", "b", None])
        when = ZERO + timedelta(seconds=rng.randint(0, 200_000))
        rows.append((i, key, when, None if i % 41 == 0 else math.nan if i % 53 == 0 else round(rng.uniform(0, 9), 2)))
    return rows


def by_key(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        out[row[1]].append(row)
    return out


def slow_segments(rows, threshold, gap, min_length):
    found = []
    for key, own in by_key(rows).items():
        segment, stuck = None, False
        for i, _, when, v in own:
            at, active = when.timestamp(), v is not None and not math.isnan(v) and v >= threshold
            if active:
                if segment and (stuck or at - segment[2] <= gap):
                    segment[2] = at
                    segment[3].append(v)
                else:
                    segment = [key, at, at, [v]]
                    found.append(segment)
            stuck = active
    return sorted(
        (str(k), a, b, len(vs), round(sum(vs), 6), max(vs)) for k, a, b, vs in found if b - a >= min_length
    )


@pytest.mark.parametrize(("threshold", "gap", "length"), [(8.0, 600, 0), (6.0, 60, 30), (2.0, 5, 500), (-1.0, 0, 0), (10.0, 60, 0)])
def test_segments_match_a_walk(spark, many_blocks, threshold, gap, length):
    df = spark.createDataFrame(rows_of(), KIND)
    found = series.activity_segments(df, ["k"], "ts", "i", "v", threshold, gap, length).collect()
    mine = sorted((str(r.k), r.start, r.end, r["rows"], round(r.total, 6), r.peak) for r in found)
    assert mine == slow_segments(rows_of(), threshold, gap, length)


def test_segments_of_one_key_and_of_none(spark, many_blocks):
    rows = [(i, "one", ZERO + timedelta(seconds=i), 1.0) for i in range(5000)]
    df = spark.createDataFrame(rows + [(9999, "one", None, 5.0)], KIND)
    found = series.activity_segments(df, ["k"], "ts", "i", "v", 1.0, 0, 0).collect()
    assert [(r["rows"], r.end - r.start, r.peak) for r in found] == [(5000, 4999.0, 1.0)]
    assert series.activity_segments(df.where("false"), ["k"], "ts", "i", "v", 1.0, 0, 0).collect() == []


def test_islands_of_intervals(spark, many_blocks):
    """A long interval swallows later short ones, across blocks too."""
    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), rng.randint(0, 20_000), rng.choice([1, 5, 1500])) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, k string, a long, n long")
    found = ordered.islands(df, ["k"], ["a", "i"], F.col("a"), F.col("a") + F.col("n"), 2, {"most": (F.max, F.col("n"))})
    expected = []
    for key in "xy":
        own = None
        for i, k, a, n in sorted(rows, key=lambda r: (r[2], r[0])):
            if k != key:
                continue
            if own and a - own[2] <= 2:
                own[2], own[3], own[4] = max(own[2], a + n), own[3] + 1, max(own[4], n)
            else:
                own = [key, a, a + n, 1, n]
                expected.append(own)
    assert sorted(tuple(r) for r in found.collect()) == sorted(map(tuple, expected))


@pytest.mark.parametrize("chunk_rows", [3, 8, 10_000])
def test_framed_looks_both_ways(spark, chunk_rows):
    df = spark.createDataFrame(rows_of(500), KIND)
    outs = {"p": lambda w: F.lag("i", 2).over(w), "n": lambda w: F.lead("i", 3).over(w)}
    found = {r.i: (r.p, r.n) for r in ordered.framed(df, ["k"], ["ts", "i"], 2, 3, outs, chunk_rows).collect()}
    assert len(found) == 500
    for own in by_key(rows_of(500)).values():
        ids = [r[0] for r in own]
        for at, i in enumerate(ids):
            assert found[i] == (ids[at - 2] if at >= 2 else None, ids[at + 3] if at + 3 < len(ids) else None)


def slow_quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = values[math.floor(at)]
    return low + (values[math.ceil(at)] - low) * (at - math.floor(at))


@pytest.mark.parametrize(("bracket", "broadcast"), [(10, 1000), (200_000, 1000), (10, 0)])
def test_quantiles_are_exact(spark, many_blocks, bracket, broadcast):
    rng = random.Random(6)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(20_000)] + [("ties", float(rng.randint(0, 3))) for _ in range(5_000)]
    rows += [("same", 2.5)] * 3_000 + [(None, rng.random()) for _ in range(300)] + [("one", 7.0), ("none", None), ("none", math.nan)]
    rows += [("wide", rng.choice([1e-9, 1.0, 1e9, -1e9])) for _ in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double")
    asked = {"least": 0.0, "low": 0.01, "mid": 0.5, "high": 0.99, "most": 1.0}
    found = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], F.col("v"), asked, bracket, broadcast).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None and not math.isnan(v):
            groups[k].append(v)
    assert set(found) == set(groups)
    for k, values in groups.items():
        assert found[k].n == len(values)
        assert [found[k][name] for name in asked] == [slow_quantile(values, p) for p in asked.values()], k


def test_scaling_keeps_all_rows(spark):
    rows = [(i, "g", float(i)) for i in range(101)] + [(200, "c", 4.0), (201, "c", 4.0), (202, None, 1.0), (203, "g", None), (204, "n", math.nan)]
    df = spark.createDataFrame(rows, "i long, g string, v double")
    found = {r.i: r.scaled for r in series.normalize_by_quantiles(df, ["g"], "v").collect()}
    assert len(found) == len(rows)
    assert found[0] == found[1] == -1.0 and found[100] == found[99] == 1.0 and found[50] == pytest.approx(0.0)
    assert (found[200], found[202], found[203], found[204]) == (0.0, 0.0, None, None)
    assert series.normalize_by_quantiles(df.where("false"), ["g"], "v").collect() == []


def slow_marks(rows, unit, bucket, fan=3):
    marks = {}
    for key, own in by_key(rows).items():
        own = [(r[2].timestamp(), r[3]) for r in own if key is not None and r[3] is not None and not math.isnan(r[3])]
        peaks = [own[i] for i in range(1, len(own) - 1) if own[i - 1][1] < own[i][1] >= own[i + 1][1]]
        peaks = [(math.floor(t / unit), math.floor(v / bucket)) for t, v in peaks]
        marks[key] = {(a[0], a[1], b[1], b[0] - a[0]) for i, a in enumerate(peaks) for b in peaks[i + 1 : i + 1 + fan]}
    return {k: m for k, m in marks.items() if m}


def slow_pairs(marks, votes):
    whole = {k: (min(m)[0], tuple(sorted((x[0] - min(m)[0], *x[1:]) for x in m))) for k, m in marks.items()}
    rep = {k: min(j for j in whole if whole[j][1] == whole[k][1]) for k in whole}
    result = {(rep[k], k, whole[k][0] - whole[rep[k]][0], len(marks[k]), True) for k in rep if k != rep[k] and len(marks[k]) >= votes}
    singles = sorted(set(rep.values()))
    for n, a in enumerate(singles):
        for b in singles[n + 1 :]:
            counts = Counter(y[0] - x[0] for x in marks[a] for y in marks[b] if x[1:] == y[1:])
            best = max(((c, -s) for s, c in counts.items()), default=(0, 0))
            if best[0] >= votes:
                result.add((a, b, -best[1], best[0], False))
    return result


@pytest.mark.parametrize("levels", [3, 40])
def test_repeated_series_match_all_pairs(spark, levels):
    """Few levels make a few very frequent marks; some series are copies, some share a stretch."""
    rng = random.Random(levels)
    rows, i = [], 0
    songs = [[(3600 * t * rng.randint(1, 3), float(rng.randint(0, levels))) for t in range(60)] for _ in range(8)]
    for s, song in enumerate(songs):
        song = sorted(song)
        for copy in range(rng.randint(1, 4)):
            cut = song if copy % 2 == 0 else song[10:50]
            shift = 3600 * rng.randint(0, 500)
            for t, v in cut:
                rows.append((i, f"s{s}-{copy}", ZERO + timedelta(seconds=t + shift), v))
                i += 1
    rows += [(i, None, ZERO, 1.0), (i + 1, "short", ZERO, 1.0), (i + 2, "nan", ZERO, math.nan), (i + 3, "none", ZERO, None)]
    df = spark.createDataFrame(rows, KIND)
    found = {tuple(r) for r in series.repeated_series(df, "k", "ts", "i", "v", 3600.0, 1.0, 3, 5).collect()}
    assert found == slow_pairs(slow_marks(rows, 3600.0, 1.0), 5)
    assert any(r[4] for r in found) and any(not r[4] for r in found)
    assert series.repeated_series(df.where("false"), "k", "ts", "i", "v").collect() == []


def test_chance_meetings_are_dropped_before_votes_are_looked_up(spark, monkeypatch):
    """Series that share a mark by chance must not have all their marks moved to each other."""
    rng, rows, counts = random.Random(12), [], {}
    for key in range(60):
        rows += [(len(rows) + t, f"k{key}", ZERO + timedelta(hours=2 * t), float(rng.randint(0, 12))) for t in range(60)]
    settled = series.settled

    def counting(df, name):
        kept = settled(df, name)
        counts[name] = kept.count()
        return kept

    monkeypatch.setattr(series, "settled", counting)
    df = spark.createDataFrame(rows, KIND)
    found = {tuple(r) for r in series.repeated_series(df, "k", "ts", "i", "v", 3600.0, 1.0, 3, 5).collect()}
    assert found == slow_pairs(slow_marks(rows, 3600.0, 1.0), 5)
    assert counts["series-met"] > 1000 and counts["series-near"] < counts["series-met"] / 10


@pytest.mark.parametrize("rare,class_marks,votes", [(2, 256, 5), (0, 256, 5), (2, 4, 5), (0, 8, 4), (1, 6, 3), (0, 256, 2), (0, 256, 1)])
def test_common_marks_meet_in_twos_and_lose_no_pair(spark, rare, class_marks, votes):
    rng, rows = random.Random(31 + votes), []
    songs = [sorted((2 * rng.randint(0, 90), float(rng.randint(0, 6))) for _ in range(45)) for _ in range(5)]
    for s, song in enumerate(songs):
        for part, cut in enumerate([song, song[:24], song[18:], [x for x in song if rng.random() > 0.2]]):
            rows += [(len(rows) + i, f"s{s}-{part}", ZERO + timedelta(hours=t + 7 * part), v) for i, (t, v) in enumerate(cut)]
    rows += [(len(rows) + t, "long", ZERO + timedelta(hours=t), float(rng.randint(0, 6))) for t in range(300)]
    df = spark.createDataFrame(rows, KIND)
    found = {tuple(r) for r in series.repeated_series(df, "k", "ts", "i", "v", 3600.0, 1.0, 3, votes, rare, class_marks).collect()}
    assert found == slow_pairs(slow_marks(rows, 3600.0, 1.0), votes)


def test_series_that_share_a_common_mark_by_chance_make_few_meetings(spark, monkeypatch):
    """All 150 keys have six marks in common, at other distances: 11,175 pairs of keys for each mark, which need not meet."""
    rng, rows, counts = random.Random(4), [], {}
    for key in range(150):
        when = 0
        for motif in range(6):
            for v in (0, 9 + motif, 0, 20 + motif, 0):
                rows.append((len(rows), f"k{key}", ZERO + timedelta(hours=when), 10.0 * v))
                when += 1
            when += rng.randint(10, 4000)
    settled = series.settled

    def counting(df, name):
        kept = settled(df, name)
        counts[name] = kept.count()
        return kept

    monkeypatch.setattr(series, "settled", counting)
    df = spark.createDataFrame(rows, KIND)
    found = {tuple(r) for r in series.repeated_series(df, "k", "ts", "i", "v", 3600.0, 1.0).collect()}
    assert found == slow_pairs(slow_marks(rows, 3600.0, 1.0), 5)
    assert counts["series-met"] < 1000


@pytest.mark.parametrize("key_rows", [0, 20, 10_000])
def test_landmarks_of_long_keys_are_those_of_short_ones(spark, key_rows):
    rows = rows_of(600) + [(9000, None, ZERO, 1.0), (9001, "nan", ZERO, math.nan), (9002, "x", None, 1.0)]
    marks = series.landmarks(spark.createDataFrame(rows, KIND), "k", "ts", "i", "v", 3600.0, 10.0, 3, key_rows).collect()
    expected = slow_marks([r for r in rows if r[2] is not None], 3600.0, 10.0)
    assert {(r.key, r.begin, r.at, r.first, r.second, r.apart) for r in marks} == {(k, min(m)[0], *x) for k, m in expected.items() for x in m}
    assert len(marks) == sum(map(len, expected.values()))


def slow_sessions(rows, gap):
    found = []
    for key, own in by_key(rows).items():
        for _, _, when, _ in own:
            if found and found[-1][0] == key and when - found[-1][2] < gap:
                found[-1][2], found[-1][3] = when, found[-1][3] + 1
            else:
                found.append([key, when, when, 1])
    return sorted((str(k), a, b + gap, n) for k, a, b, n in found)


def stream_of(spark, rows, folder, parts):
    for part in parts:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(folder)
    return stream_files(spark, folder, "*.parquet", "ts", files_per_batch=1)


def test_sessions_over_batches_are_all_there(spark, tmp_path):
    rows = sorted(rows_of(600), key=lambda r: r[2])
    rows += [(9000, "edge", ZERO, 0.0), (9001, "edge", ZERO + timedelta(minutes=30), 0.0), (9002, "edge", ZERO + timedelta(minutes=59), 0.0)]
    rows = sorted(rows, key=lambda r: r[2])
    stream = stream_of(spark, rows, str(tmp_path / "in"), [rows[i : i + 151] for i in range(0, len(rows), 151)])
    found = stream_sessions(stream, "ts", "k", str(tmp_path / "out")).collect()
    mine = sorted((str(r.k), r.session_start, r.session_end, r.events) for r in found)
    assert mine == slow_sessions(rows, timedelta(minutes=30))
    limit = max(r[2] for r in rows) - timedelta(hours=1)
    assert all(r.open == (r.session_end > limit) for r in found) and {r.open for r in found} == {True, False}


def test_sessions_of_late_events_count_too(spark, tmp_path):
    rows = rows_of(400)
    stream = stream_of(spark, rows, str(tmp_path / "in"), [rows[:200], rows[200:] + [(1, "x", None, 1.0)]])
    late = stream_sessions(stream, "ts", "k", str(tmp_path / "out"))
    assert late.agg(F.sum("events")).first()[0] == len(rows)
    stream = stream_of(spark, rows, str(tmp_path / "in2"), [rows[:200], rows[200:]])
    whole = stream_sessions(stream, "ts", "k", str(tmp_path / "out2"), watermark="100 days").collect()
    assert sorted((str(r.k), r.session_start, r.session_end, r.events) for r in whole) == slow_sessions(rows, timedelta(minutes=30))
    assert all(r.open for r in whole)
