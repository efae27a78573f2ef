"""SimHash near-duplicates and fuzzy lines against brute force, with odd rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import lines, simhash
from tallyforge.llm.common import components


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def slow_fingerprint(text):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(30)]
    rows = []
    for text in base:
        rows.append(text)
        own = text.split()
        for _ in range(rng.randint(0, 3)):
            changed = list(own)
            changed[rng.randrange(len(own))] = "zzz"
            rows.append(" ".join(changed))
    return rows + [None, "", " \t ", "one", "ONE", "one two", "Ä ä", base[0], base[0], "a " * 30_000]


def test_components_of_a_chain_a_star_and_a_ring(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    links = spark.createDataFrame(pairs + [(7, 6), (300, 300)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components(links, "t").collect()}
    assert found == {k: v for k, v in union_find({n for p in pairs for n in p}, pairs).items()}


def test_no_links_give_no_components(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "t").count() == 0


def test_near_duplicates_match_all_pairs(docs, texts):
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    prints = {i: slow_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = union_find(prints, pairs)
    found = simhash.near_duplicates(docs(rows)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {
        i: (f"{prints[i]:016x}", expected[i]) for i in prints
    }
    assert len(set(expected.values())) < len(rows) - 10


def test_near_duplicates_of_odd_rows(spark, docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    frame = docs([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "x y z w")])
    clash = frame.withColumnsRenamed({"lang": "fingerprint", "source": "component_id", "n_chars": "id"})
    found = simhash.near_duplicates(clash).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"]) == [(5, 5), (5, 5)]
    assert sorted(str(r["component_id"]) for r in found if not r["doc_id"]) == ["5", "None"]


def test_keep_one_leaves_one_row_per_group(docs, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = docs(rows).withColumnRenamed("lang", "text_key").withColumnRenamed("source", "winner")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    groups = {r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert {r["doc_id"] for r in kept.collect()} == groups
    twice = simhash.keep_one(docs([(1, "a b c d"), (1, "a b c d"), (None, "a b c d")])).collect()
    assert [r["doc_id"] for r in twice] == [1]


def jaccard(a, b):
    x, y = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def slow_dedup(rows):
    """Text of each row with every line dropped that is linked to an earlier one."""
    found = [(i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if line.strip(lines.WHITE)]
    distinct = sorted({line for *_, line in found})
    pairs = [(a, b) for n, a in enumerate(distinct) for b in distinct[n + 1 :] if jaccard(a, b) >= 0.8]
    of = union_find(distinct, pairs)
    first = {}
    for i, k, line in found:
        first.setdefault(of[line], (i, k))
    gone = {(i, k) for i, k, line in found if first[of[line]] != (i, k)}
    return {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_lines_match_brute_force(docs):
    rng = random.Random(8)
    pool = [words(rng, rng.randint(40, 60)) for _ in range(60)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool) if rng.random() < 0.4 else words(rng, rng.randint(5, 50))
            if rng.random() < 0.3 and len(line) > 150:
                line = line.replace(" ", " x", 1)
            own.append(line)
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n \n\n"), (103, "short"), (104, "short\n\nshort"), (105, "日本語の文字列が続く" * 4)]
    rows += [(106, "日本語の文字列が続く" * 4 + "よ"), (107, "w " * 20_000)]
    found = {r["doc_id"]: r for r in lines.dedup_lines(docs(rows)).collect()}
    assert {i: r["text"] for i, r in found.items()} == slow_dedup(rows)
    assert (found[104]["n_lines"], found[104]["n_removed"]) == (2, 2)
    assert (found[100]["n_lines"], found[100]["text"]) == (0, None)


def test_lines_of_odd_rows(docs):
    assert lines.dedup_lines(docs([])).collect() == []
    frame = docs([(1, "same line here"), (1, "same line here"), (None, "same line here\nown line of it")])
    frame = frame.withColumnsRenamed({"lang": "n_lines", "source": "line", "n_chars": "gone"})
    cut = lines.dedup_lines(frame)
    assert cut.columns == [*frame.columns, "n_lines_", "n_removed"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in cut.collect()) == [
        ("1", "same line here"),
        ("1", "same line here"),
        ("None", "own line of it"),
    ]


def test_odd_lines_of_a_bucket_meet_again_in_finer_ones(spark):
    # Lines 11 and 12 share two bands, but in each an unlike line is the representative.
    keys = {9: [8, 4, 20], 10: [1, 2, 3], 11: [1, 4, 5], 12: [1, 4, 6], 13: [7, 30, 3]}
    bands = spark.createDataFrame(list(keys.items()), "h bigint, bands array<bigint>")
    text = {10: "a" * 30 + "b" * 5, 11: "the one line that is alike", 12: "the one line that is alike!", 13: "other"}
    text |= {9: "c" * 40}
    frame = spark.createDataFrame(list(text.items()), "h bigint, line string")
    before = lines._bands, lines._signatures
    lines._bands, lines._signatures = (lambda _: bands), (lambda _: None)
    try:
        assert {tuple(r) for r in lines._links(frame).collect()} == {(11, 12)}
    finally:
        lines._bands, lines._signatures = before


def test_recall_among_lines_that_share_a_passage(docs):
    """A passage that many lines share fills buckets with unlike lines; alike ones are still found."""
    rng = random.Random(12)
    passage = words(rng, 40)
    rows, expected = [], set()
    for i in range(150):
        own = words(rng, 25)
        rows.append((i, f"{passage} {own}"))
        if i % 3 == 0:
            rows.append((1000 + i, f"{passage} {own} more"))
            expected.add(1000 + i)
    cut = {r["doc_id"] for r in lines.dedup_lines(docs(rows)).collect() if r["n_removed"]}
    assert cut <= expected and len(cut) >= 0.97 * len(expected)


@pytest.mark.parametrize("blanks", [0, 5, 40, 99])
def test_a_blank_more_or_less_parts_no_lines(docs, blanks):
    """Lines of long words around the limit where anchors change, and lines without blanks."""
    rng = random.Random(blanks)
    units = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(12, 20))) for _ in range(100)]
    line = "".join(u + (" " if i < blanks else "") for i, u in enumerate(units))
    more, less = line[:700] + " " + line[700:], line.replace(" ", "", 1)
    cut = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs([(1, line), (2, more), (3, less), (4, "other line")])).collect()}
    assert cut == {1: line, 2: "", 3: "", 4: "other line"}


def alike_pairs(texts):
    """All pairs at 0.8 or more, through an index of shingles: sizes of intersections, no pair left out."""
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    numbers = {s: n for n, s in enumerate(set().union(*sets))}
    table = np.zeros((len(texts), len(numbers)), np.float32)
    for row, own in zip(table, sets):
        row[[numbers[s] for s in own]] = 1
    shared, sizes = table @ table.T, table.sum(axis=1)
    a, b = np.nonzero(shared >= 0.8 * (sizes[:, None] + sizes[None] - shared) - 1e-3)
    return [(int(x), int(y)) for x, y in zip(a, b) if x < y and jaccard(texts[x], texts[y]) >= 0.8]


def links_of_one_bucket(spark, texts, monkeypatch):
    """Links when all lines share one band, whose representative is the first."""
    star = spark.createDataFrame([(1, 0, h) for h in range(1, len(texts))], "band bigint, rep bigint, h bigint")
    monkeypatch.setattr(lines, "_signatures", lambda _: None)
    monkeypatch.setattr(lines, "_bands", lambda _: None)
    monkeypatch.setattr(lines, "_candidates", lambda _: star)
    return {tuple(r) for r in lines._links(spark.createDataFrame(list(enumerate(texts)), "h bigint, line string")).collect()}


def test_odd_members_of_a_bucket_are_compared_with_all(spark, monkeypatch):
    texts = ["a" * 30 + "b" * 5, "the one line that is alike", "the one line that is alike!", "other"]
    assert links_of_one_bucket(spark, texts, monkeypatch) == {(1, 2)}


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("share", [0.80, 0.84, 0.88])
def test_templates_of_thousands_of_lines_lose_no_link(spark, monkeypatch, few, share):
    """Lines share most of their text and are unlike; each has an alike partner only at one edit."""
    monkeypatch.setattr(lines, "FEW_ODD", few)
    rng = random.Random(int(share * 100))
    template, texts = words(rng, 50), []
    own = round(len(template) * (1 - share) / share)
    for i in range(1200):
        line = f"{template} " + "".join(rng.choice("klmnopqrstuvwxyz") for _ in range(own))
        texts += [line, "xy" + line[2:] + "z"] if i % 2 else [line]
    expected = alike_pairs(texts)
    assert len(expected) >= 600
    found = links_of_one_bucket(spark, texts, monkeypatch)
    assert union_find(range(len(texts)), found) == union_find(range(len(texts)), expected)


def test_a_text_is_split_once_and_not_for_each_kept_line(docs, capsys):
    frame = docs([(1, "first line of words\nsecond line here\nfirst line of words"), (2, "second line here\nother"), (3, None)])
    cut = lines.dedup_lines(frame)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in cut.collect()} == {
        1: ("first line of words\nsecond line here", 3, 1), 2: ("other", 2, 1), 3: (None, 0, 0)
    }
    cut.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]
    assert "split(" in plan and "lambdafunction(split(" not in plan


def test_a_pair_of_odd_lines_in_several_buckets_is_met_once(spark, monkeypatch):
    """Lines 1 to 9 are alike by size and parities and share three buckets, in which 1 to 6 are odd; 20 has one more."""
    rows = [(band, h, min(h, 7), h < 7, 6) for band in (30, 10, 20) for h in range(1, 10)]
    rows += [(40, h, min(h, 7), h < 7, 2) for h in (5, 6)] + [(band, 20, 20, True, 6) for band in (30, 40)]
    members = spark.createDataFrame(rows, "band bigint, h bigint, root bigint, odd boolean, n_odd bigint")
    text = "one line of a template that many others share"
    texts = spark.createDataFrame([(h, text) for h in [*range(1, 10), 20]], "h bigint, line string")
    made, met = [], lines._met
    monkeypatch.setattr(lines, "_met", lambda *args: made.append(met(*args)) or made[-1])
    expected = {(a, b) for a in range(1, 7) for b in range(a + 1, 10)} | {(a, 20) for a in range(1, 10)}
    for few in (100, 0):
        made.clear()
        monkeypatch.setattr(lines, "FEW_ODD", few)
        assert {tuple(r) for r in lines._rest_pairs(members, texts).collect()} == expected
        found = [tuple(r) for r in made[-1].collect()]
        assert set(found) == expected
        if few:
            assert len(found) == len(expected)


def test_pairs_that_links_join_already_are_not_verified(spark, monkeypatch):
    """A template's lines are linked in many ways; verified in part ahead, the others are mostly joined already."""
    rng = random.Random(31)
    template, texts = words(rng, 60), ["z" * 40]
    for i in range(60):
        at = rng.randrange(len(template) - 4)
        texts.append(f"{template[:at]}{rng.choice('klmn') * 4}{template[at + 4 :]} " + words(rng, 1))
    expected = union_find(range(len(texts)), alike_pairs(texts))
    verified, asked = lines._verified, []
    monkeypatch.setattr(lines, "_verified", lambda pairs, own: asked.append(pairs.count()) or verified(pairs, own))
    found, sizes = {}, {}
    for many in (10**9, 0):
        asked.clear()
        monkeypatch.setattr(lines, "MANY_PAIRS", many)
        found[many] = union_find(range(len(texts)), links_of_one_bucket(spark, texts, monkeypatch))
        sizes[many] = sum(asked[1:])
    assert found[0] == found[10**9] == expected
    assert sizes[0] < sizes[10**9] / 2


def test_shingles_are_all_runs_of_characters(spark):
    rng = random.Random(17)
    alphabet = ["a", "b", " ", "\t", "\r", "\x85", "\u2028", "é", "日", "\ufffd", "e\u0301", ".", "$"]
    texts = ["", "a", "abcd", "abcde", "a😀", "😀" * 9, "ab😀cd😀ef gh", "x\r" * 40, "y" * 70_000 + "z"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += ["".join(rng.choice([*alphabet, "😀", "\U0010ffff"]) for _ in range(100)) for _ in range(9)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")
    for row in frame.select("line", lines._shingles(F.col("line")).alias("s")).collect():
        own = {row.line[k : k + 5].encode() for k in range(max(1, len(row.line) - 4))}
        assert len(row.s) == len(own)
        assert {x % 2**64 for x in row.s} == {xxhash.xxh64_intdigest(x, 42) for x in own}


def test_shingles_of_a_line_in_several_buckets_are_ranked_once(spark, monkeypatch):
    rng = random.Random(19)
    template = words(rng, 30)
    own = {h: f"{template} {words(rng, 3)}" for h in range(30)}
    members = [(band, h, h, h > 0, 29) for band in range(5) for h in own]
    members = spark.createDataFrame(members, "band bigint, h bigint, root bigint, odd boolean, n_odd bigint")
    texts = spark.createDataFrame(list(own.items()), "h bigint, line string")
    prefixes, made = lines._prefixes, []
    monkeypatch.setattr(lines, "FEW_ODD", 0)
    monkeypatch.setattr(lines, "_prefixes", lambda *args: made.append(prefixes(*args)) or made[-1])
    found = {tuple(r) for r in lines._rest_pairs(members, texts).collect()}
    assert set(alike_pairs([own[h] for h in range(30)])) <= found
    (ranked,) = made
    assert 0 < ranked.count() == ranked.select("h", "s").distinct().count()


@pytest.mark.parametrize("few", [0, 100_000])
def test_pairs_that_links_join_already_are_not_met(spark, monkeypatch, few):
    """Of a group of alike lines a part is met first; the pairs which that joins are not made, by bucket or by shingle."""
    rng = random.Random(23)
    template, texts = words(rng, 80), ["z" * 40]
    for _ in range(60):
        at = rng.randrange(len(template) - 4)
        texts.append(f"{template[:at]}{rng.choice('klmn') * 4}{template[at + 4 :]} " + words(rng, 1))
    met, made = lines._met, []
    monkeypatch.setattr(lines, "FEW_ODD", few)
    monkeypatch.setattr(lines, "MANY_PAIRS", 0)
    monkeypatch.setattr(lines, "_met", lambda *args: made.append(met(*args).distinct()) or made[-1])
    links = links_of_one_bucket(spark, texts, monkeypatch)
    expected = alike_pairs(texts)
    assert union_find(range(len(texts)), links) == union_find(range(len(texts)), expected)
    assert sum(pairs.count() for pairs in made) < len(expected) / 2
