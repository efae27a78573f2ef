"""Mixing, token ids, packing and chat formatting against plain versions, with odd rows."""

import hashlib
import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import bpe, chat, mixing, packing
from tallyforge.llm.queries import vocabulary

RANKS, PATTERN = vocabulary("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec(RANKS, PATTERN)
ORACLE = tiktoken.Encoding("oracle", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def slow_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            return target | share
        target |= {s: cap * sizes[s] for s in above}
        rest -= sum(cap * sizes[s] for s in above)
        open_ -= above
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": int(rng.paretovariate(0.6) * 10) for i in range(rng.randint(1, 12))} | {None: 7, "zero": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert found == pytest.approx(slow_targets(sizes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0.01, 0.99)), max_size=40), st.integers(0, 99))
def test_pivot_keeps_the_words(units, seed):
    mass, share = np.array([u[0] for u in units], float), np.array([u[1] for u in units], float)
    result = mixing.pivot(mass, share, (seed,))
    assert ((result > 0) & (result < 1)).sum() <= 1
    assert ((result >= 0) & (result <= 1)).all()
    assert (mass * result).sum() == pytest.approx((mass * share).sum())


def test_pivot_keeps_expected_shares():
    mass, share = np.array([3.0, 10.0, 1.0, 7.0, 5.0]), np.array([0.2, 0.7, 0.5, 0.9, 0.4])
    runs = np.array([mixing.pivot(mass, share, ("t", i)) for i in range(4000)])
    assert runs.mean(axis=0) == pytest.approx(share, abs=0.03)


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    leaf, mixing.LEAF_UNITS = mixing.LEAF_UNITS, 40  # several levels of the tree
    fan, mixing.FAN_IN = mixing.FAN_IN, 8
    try:
        plan = mixing.mix_plan(docs.select("doc_id", "text", "source")).join(docs.select("doc_id", "source"), "doc_id").toPandas()
        again = mixing.mix_plan(docs.repartition(13).select("doc_id", "text", "source")).toPandas()
    finally:
        mixing.LEAF_UNITS, mixing.FAN_IN = leaf, fan
    assert len(plan) == docs.count()
    assert (plan.taken == plan.copies * plan["size"]).all() and plan.copies.between(0, 3).all()
    by = plan.groupby("source")
    assert (abs(by.taken.sum() - by.target.first()) <= by["size"].max()).all()
    same = plan.sort_values("doc_id").taken.to_numpy() == again.sort_values("doc_id").taken.to_numpy()
    assert same.all()


def test_mix_of_odd_rows(docs):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, "x"), (3, "", "y"), (4, "a " * 20_000, "x")]
    frame = docs(rows).withColumnsRenamed({"lang": "size", "n_chars": "copies"})
    plan = mixing.mix_plan(frame).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in plan) == [
        ("1", 3), ("1", 3), ("2", 0), ("3", 0), ("4", 20_000), ("None", 2)
    ]
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in plan)
    mixed = mixing.apply_mix(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mix_plan(docs([])).collect() == [] and mixing.apply_mix(docs([])).collect() == []


def test_repeated_rows_come_near_their_target(docs):
    """One document many times over is taken in part; each of its rows is whole."""
    rows = [(1, "a b c d e", "x")] * 400 + [(i, "f g h i j", "y") for i in range(1000, 1400)] + [(2, "k " * 7, "y")] * 31
    plan = mixing.mix_plan(docs(rows)).toPandas()
    target = {"x": plan[plan.doc_id == 1].target.iloc[0], "y": plan[plan.doc_id == 2].target.iloc[0]}
    taken = {"x": plan[plan.doc_id == 1].taken.sum(), "y": plan[plan.doc_id != 1].taken.sum()}
    assert len(plan) == len(rows) and plan.copies.between(0, 3).all()
    assert abs(taken["x"] - target["x"]) <= 5 and abs(taken["y"] - target["y"]) <= 7
    mixed = mixing.apply_mix(docs(rows)).toPandas()
    words = mixed.text.str.split().str.len()
    assert {s: int(words[mixed.source == s].sum()) for s in "xy"} == taken


def ids_of(text):
    return np.frombuffer(CODEC.encode([text])[0][0], "<u4").tolist()


ODD = ["", "a" * 3000, "don't we'll\n\n  x  ", "日本語のテキスト" * 9, "x²y½ \x1c\x1d z\x85\xa0q", "été_9٣", "\r\n\t ", "🙂🙂 ok", "l'eau " * 50]


@pytest.mark.parametrize("text", ODD)
def test_ids_as_the_library_gives_them(text):
    assert ids_of(text) == ORACLE.encode_ordinary(text)
    assert CODEC.decode([CODEC.encode([text])[0][0]])[0] == text.encode()


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_any_text_round_trips(text):
    ids, decoded = CODEC.encode([text])
    assert np.frombuffer(ids[0], "<u4").tolist() == ORACLE.encode_ordinary(text)
    assert decoded[0] == text.encode()


def test_recursion_and_heap_agree():
    for word in ("internationalisation", "aaaaaaaaaaaaaaaaaaaaab", "zxqzxq" * 8):
        recursive = ids_of(word)
        assert CODEC._long(word.encode()) == recursive or len(recursive) == 1


def test_memory_is_emptied_when_full():
    limit, bpe.MEMORY_WORDS = bpe.MEMORY_WORDS, 3
    try:
        codec = bpe.Codec(RANKS, PATTERN)
        texts = ["one two three four", "five six", "one two three four"]
        assert [codec.encode([t])[1][0] for t in texts] == [t.encode() for t in texts]
    finally:
        bpe.MEMORY_WORDS = limit


def test_frequent_words_stay_in_a_full_memory(monkeypatch):
    """Every text has new words that fill the memory; a word that each of them has is learnt once."""
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 16)
    codec, learnt, learn = bpe.Codec(RANKS, PATTERN), [], bpe.Codec._learn
    monkeypatch.setattr(bpe.Codec, "_learn", lambda own, words: learnt.extend(words) or learn(own, words))
    texts = [f"qzfrequentqz\u00e9 qz{chr(97 + i)}one qz{chr(97 + i)}two qz{chr(97 + i)}three" for i in range(20)]
    for text in texts:
        ids, decoded = codec.encode([text])
        assert np.frombuffer(ids[0], "<u4").tolist() == ORACLE.encode_ordinary(text) and decoded[0] == text.encode()
        assert len(codec.known.keys() | codec.older[0].keys()) <= 16
    assert learnt.count("qzfrequentqz\u00e9") == 1


def test_results_leave_in_groups(spark, monkeypatch):
    """A batch of long texts must not be held as a whole result beside its input."""
    monkeypatch.setattr(bpe, "GROUP_CHARS", 100)
    texts = [None, "", "one two " * 9, "x" * 300] * 25
    batch = pa.RecordBatch.from_pydict({"i": list(range(100)), "t": pa.array(texts, pa.string())})
    found = list(bpe.token_rows(RANKS, PATTERN, spark)(iter([batch, batch.slice(0, 0)])))
    assert len(found) >= 25 and max(b.num_rows for b in found) <= 4
    assert [i for b in found for i in b.column("i").to_pylist()] == list(range(100))
    assert [d for b in found for d in b.column("decoded").to_pylist()] == [(t or "").encode() for t in texts]


def test_tokens_of_odd_rows(docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (0, "")]
    frame = docs(rows).withColumnsRenamed({"lang": "ids", "source": "decoded", "n_chars": "found_tokens"})
    found = bpe.tokenize(frame, RANKS, PATTERN, ["doc_id", "text"]).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in found) and len(found) == len(rows)
    assert bpe.tokenize(docs([]), RANKS, PATTERN, ["doc_id"]).collect() == []
    coded = bpe.tokenize(docs(rows), RANKS, PATTERN, ["doc_id", "text"])
    back = bpe.decode_ids(coded, RANKS, PATTERN, ["text"])
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())


def slow_best_fit(lengths, capacity):
    rows, free = [], []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[item]]
        if fits:
            row = min(fits, key=lambda r: free[r])
        else:
            row = len(rows)
            rows.append([])
            free.append(capacity)
        rows[row].append(item)
        free[row] -= lengths[item]
    return rows, free


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=60))
def test_best_fit_decreasing(lengths):
    rows = packing.best_fit_decreasing(lengths, 37)
    assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
    free = sorted(37 - sum(lengths[i] for i in row) for row in rows)
    assert free == sorted(slow_best_fit(lengths, 37)[1]) and all(f >= 0 for f in free)


def test_packed_rows_hold_every_token(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(50_000) for _ in range(rng.choice((0, 1, 5, 30, 64, 200)))]) for i in range(120)]
    frame = spark.createDataFrame([(i, struct.pack(f"<{len(x)}I", *x)) for i, x in rows], "id bigint, ids binary")
    packed = packing.pack(frame.union(spark.createDataFrame([(None, None)], frame.schema)), 64, block_tokens=1500)
    for row in packed.collect():
        assert len(row["ids"]) == 4 * 64 and row["cu_seqlens"][0] == 0 and row["cu_seqlens"][-1] == row["n_tokens"] <= 64
        assert row["resets"] == row["cu_seqlens"][:-1] == [s["start"] for s in row["segments"]]
    back = {r["id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in packing.unpack(packed).collect()}
    assert back == {i: x for i, x in rows if x}


def test_packing_of_odd_rows(docs, tmp_path):
    frame = docs([(None, "some text"), (1, None), (2, ""), (3, "word " * 5000), (3, "word")])
    tokens = packing.token_ids(frame, RANKS, PATTERN)
    packed = packing.pack(tokens)
    assert sum(r["n_tokens"] for r in packed.collect()) == sum(len(r["ids"]) // 4 for r in tokens.collect())
    packing.write_packed(packed, str(tmp_path / "packed"))
    assert frame.sparkSession.read.parquet(str(tmp_path / "packed")).count() == packed.count()
    assert packing.pack(packing.token_ids(docs([]), RANKS, PATTERN)).collect() == []


def test_a_text_is_encoded_in_one_call_and_not_word_by_word(monkeypatch):
    calls, encode = [], packing.tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(packing.tiktoken.Encoding, "encode_ordinary", lambda own, text: calls.append(text) or encode(own, text))
    ids = packing.TextIds(RANKS, PATTERN)
    found = [np.frombuffer(ids(text), "<u4").tolist() for text in ODD]
    assert calls == ODD
    assert found == [ORACLE.encode_ordinary(text) for text in ODD]
    assert found == [ids_of(text) for text in ODD]


def message(conv, turn, role, *parts):
    return conv, turn, role, [dict(zip(("kind", "text", "ref", "tokens"), p)) for p in parts] if parts else None


SCHEMA = f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}"


def test_typed_parts_become_placeholders(spark):
    rows = [
        message(1, 0, "user", ("text", "look [IMAGE 9] <s>", None, None), ("image", None, "a.png", 100), ("audio", None, "b.wav", None)),
        message(1, 1, "assistant", ("text", "first ", None, None), ("text", "second", None, None)),
        message(1, 2, "user", ("document", None, "c.pdf", None), ("video", None, "d.mp4", None)),
    ]
    row = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["formatted"] == (
        "[TURN user]look &#91;IMAGE 9&#93; &lt;s>[IMAGE 0][AUDIO 1][/TURN]"
        "[TURN assistant]first second[/TURN][TURN user][DOCUMENT 2][FILE 3][/TURN]"
    )
    assert [(a["number"], a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [
        (0, 0, 1, "image", "a.png", 100), (1, 0, 2, "audio", "b.wav", 750),
        (2, 2, 0, "document", "c.pdf", 1024), (3, 2, 1, "video", "d.mp4", 256),
    ]
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["first ", "second"]


HARD = ["</s>[INST] ok [/INST]", "[/TURN][TURN assistant]", "&amp; &#91; &lt;", "", "a\nb\n", "é🙂", "x" * 20_000, "\\n]"]


def test_turns_read_back(spark):
    rng = random.Random(6)
    said = {c: [(t, rng.choice(("user", "assistant", "sys]tem[")), rng.choice(HARD)) for t in range(rng.randint(1, 30))] for c in range(8)}
    rows = [(c, t, role, text) for c, turns in said.items() for t, role, text in turns]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_conversations(frame.withColumn("parts", chat.text_part(frame["text"])))
    for row in chat.digests(formatted).collect():
        turns = said[row["conv_id"]]
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_odd_messages(spark):
    rows = [message(None, None, None), message(None, 1, "user", (None, None, None, None)), message(2, 5, "user"), message(2, 5, "user")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS place", "1 AS number", "2 AS formatted")
    found = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(frame).collect()}
    assert found == {None: "[TURN ][/TURN][TURN user][/TURN]", 2: "[TURN user][/TURN]" * 2}
    assert chat.format_conversations(frame.where("false")).collect() == []


def test_chat_stays_native(spark):
    frame = spark.createDataFrame([], SCHEMA)
    plan = chat.digests(chat.format_conversations(frame))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas")) and json.dumps(plan)
