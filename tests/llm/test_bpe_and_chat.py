import hashlib
import json

import pytest

from panelstack.llm import bpe, chat
from panelstack.llm.queries import op9_chat
from tests.llm import cases


@pytest.fixture(scope="module")
def vocabulary():
    from panelstack.llm.queries import ranks_and_pattern
    return ranks_and_pattern()


def test_equals_the_public_library(spark, vocabulary):
    import tiktoken
    ranks, pattern = vocabulary
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = cases.odd_docs(spark)
    got = bpe.encode_digests(docs, ranks, pattern).collect()
    assert len(got) == len(cases.ROWS)
    for i, text, *_ in cases.ROWS:
        ids = plain.encode_ordinary(text or "")
        expected = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert expected in {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id == i}
    ids = bpe.encode(docs, ranks, pattern)
    back = bpe.decode(ids, ranks).collect()
    assert sorted(bytes(r.body) for r in back) == sorted((t or "").encode() for _, t, *_ in cases.ROWS)
    assert bpe.encode_digests(cases.no_docs(spark), ranks, pattern).count() == 0


def test_replay_on_runs(vocabulary):
    import tiktoken
    ranks, _ = vocabulary
    plain = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    pieces = [b"a" * n for n in range(1, 70)] + [b"ab" * n for n in range(1, 40)] + [b"\xff\x00" * 5, ("é" * 33).encode(), b" " * 100]
    merges = bpe.Merges(ranks)
    for p, ids in zip(pieces, merges.replay(pieces), strict=True):
        assert ids == plain._encode_single_piece(p)
        assert ids == ([ranks[p]] if p in ranks else merges.one(p))


def test_low_rank_that_comes_up_late():
    """A vocabulary where a merge makes a pair of a lower rank: such a piece is merged alone."""
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {b"abc": 300, b"bc": 301, b"abcabc": 302, b"aa": 303}
    merges = bpe.Merges(ranks)
    for p in (b"abc", b"abcabc", b"aabcbcabc", b"bcaabc"):
        assert merges.replay([p, b"zz"])[0] == ([ranks[p]] if p in ranks else merges.one(p))


def test_pieces_of_a_block_are_not_kept_as_strings():
    """Beside the distinct pieces a block costs a few bytes a piece, and no row leaves Arrow before its block."""
    import tracemalloc

    import pyarrow as pa
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    texts = ["".join(f"{'ab' * (j % 5)}{(i + j) % 50} " for j in range(4000)) for i in range(60)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    run = bpe.digests(ranks, r"\w+|\W")
    tracemalloc.start()
    got, = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # 480 thousand pieces
    merges = bpe.Merges(ranks)
    ids = [x for p in (w.encode() for w in texts[3].replace(" ", "\0 \0").split("\0") if w) for x in merges.one(p)]
    assert got.column("ids_sha256")[3].as_py() == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got.column("n_tokens").to_pylist()[-2:] == [0, 0] and got.column("decoded_sha256")[3].as_py() == hashlib.sha256(texts[3].encode()).hexdigest()


ODD_TURNS = [
    (1, 0, "system", "be kind", "x"), (1, 1, "user", "hi <|im_end|>\n\\ <s>", "x"), (1, 2, "assistant", "\\[INST] <|im_start|>user<|im_sep|>", "x"), (1, 3, "user", None, "x"),
    (1, 4, "assistant", "w " * 9000, "x"), (1, 4, "assistant", "w " * 9000, "x"), (1, 5, "assistant", "", "x"), (2, 0, None, "no role", "x"), (2, None, "assistant", "no turn", "x"),
    (None, 0, "assistant", "no conversation", "x"), (3, 0, "to|ol\n<|im_sep|>", "日本🙂", "x"),
] + [(4, t, ("user", "assistant")[t % 2], f"turn {t} " + "blah " * 300, "x") for t in range(40)]


def turns_of(rows):
    groups = {}
    for c, t, role, text, *_ in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    return {c: [(x[3], x[5]) for x in sorted(v)] for c, v in groups.items()}


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    taught = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(taught), hashlib.sha256(taught.encode()).hexdigest()


def test_windows_read_back(spark):
    turns = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string, formatted string")
    windows = chat.format_windows(turns, budget=1000, history=400)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == {c: digests(t) for c, t in turns_of(ODD_TURNS).items()}
    rows = [r for r in windows.collect() if r.conv_id in (1, 4)]
    for r in rows:
        parts = chat.parse(r.formatted)
        cost = sum(chat.tokens(t) for _, t in parts)
        assert cost <= 1000 or len(parts) - r.repeated == 1  # a turn over the budget stands alone
        if r.conv_id == 1 and r.window:
            assert parts[0] == ("system", "be kind")
        if r.conv_id == 4 and r.window:
            assert 1 <= r.repeated and sum(chat.tokens(t) for _, t in parts[:r.repeated]) <= 400
    assert len([r for r in rows if r.conv_id == 4]) > 3
    assert chat.format_windows(turns.limit(0)).count() == 0


def test_escape_round_trip():
    for text in ("", "\\", "\\\\<s>", "".join(chat.CONTROL), "<|im_<|im_end|>end|>", "a\\nb", "<" + "\\" + "s>"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_query_covers_all_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op9_chat(spark, sf).collect()}
    assert got == {c: digests(t) for c, t in turns_of(rows).items()}, json.dumps(sorted(got)[:3])
