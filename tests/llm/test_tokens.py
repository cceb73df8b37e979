"""Byte-level BPE, packing and chat formatting."""

import base64
import hashlib
import random
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken

from replylens.llm import bpe, chat_format, packing, queries

RANKS = P.path(queries.RANKS)


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.read_ranks(RANKS), P.PATTERN)


def test_every_code_point_is_encoded_as_by_the_public_library(own, public):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x30000 or c % 97 == 0)]
    texts = ["".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    ours = own.encode(texts)
    odd = [i for i, t in enumerate(texts) if ours[i] != public.encode_ordinary(t)]
    assert odd == []


@pytest.mark.parametrize("letters", ["ab", "the quickon", "éa한 \n", "  \t\n"])
def test_long_pieces_by_heap_and_matrix(own, public, letters):
    draw = random.Random(4)
    for n in (1, 31, 255, 257, 3000):
        text = "".join(draw.choice(letters) for _ in range(n))
        for t in (text, text.replace(" ", "")):
            assert own.encode([t]) == [public.encode_ordinary(t)]


def test_memory_may_overflow(own, public, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    text = "one two three four two one five"
    assert own.encode([text, text]) == [public.encode_ordinary(text)] * 2


def test_query_encodes_and_decodes_all(spark, sf, docs, public):
    got = {r.doc_id: r for r in queries.op9_byte_bpe(spark, sf).collect()}
    for r in docs.collect():
        ids = public.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert len(got) == docs.count()


def test_encoding_hard_rows_and_back(hard, nothing):
    coded = bpe.encode_documents(hard, RANKS, P.PATTERN)
    back = bpe.decode_documents(coded, RANKS, P.PATTERN).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.text) for r in back], key=key) == sorted(
        [(r.doc_id, r.text or "") for r in hard.collect()], key=key
    )
    assert bpe.encode_documents(nothing, RANKS, P.PATTERN).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    draw = random.Random(1)
    for _ in range(200):
        length = draw.randint(1, 40)
        sizes = [draw.randint(1, length) for _ in range(draw.randint(0, 80))]
        rows = packing.best_fit_decreasing(sizes, length)
        left: list[int] = []
        for size in sorted(sizes, reverse=True):
            fits = [c for c in left if c >= size]
            if fits:
                left[left.index(min(fits))] -= size
            else:
                left.append(length - size)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(left)


def test_packed_rows_give_back_every_document(spark, sf, docs, public):
    packed = queries.op7_packing(spark, sf)
    rows = packed.collect()
    assert all(len(r.ids) == 4096 and len(r.position_ids) == 4096 for r in rows)
    assert all(r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 2048 for r in rows)
    got = {r.doc_id: r.ids for r in packing.unpack_documents(packed).collect()}
    assert got == {r.doc_id: [*public.encode_ordinary(r.text), queries.END_OF_TEXT] for r in docs.collect()}
    first = packing.position_ids(rows[0].cu_seqlens, 2048)
    starts = rows[0].cu_seqlens[:-1]
    assert all(first[s] == 0 for s in starts) and first.max() < 2048


def test_packing_hard_rows(hard, nothing):
    packed = packing.pack_documents(hard, RANKS, P.PATTERN, queries.END_OF_TEXT, length=16)
    pieces = [(d, p) for r in packed.collect() for d, p in zip(r.doc_ids, r.pieces)]
    assert len({d for d, _ in pieces}) == 10
    assert pieces.count((2, 0)) == 2 and (3, 0) in pieces and (None, 0) in pieces
    assert packing.pack_documents(nothing, RANKS, P.PATTERN, 0).count() == 0


def test_unpacking_repeated_and_missing_ids(hard, nothing, public, tmp_path):
    packed = packing.pack_documents(hard, RANKS, P.PATTERN, queries.END_OF_TEXT, length=16, positions=True)
    written = packing.write_packed(packed, str(tmp_path / "packed"))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(r.doc_id, [*public.encode_ordinary(r.text or ""), queries.END_OF_TEXT]) for r in hard.collect()]
    for table in (packed, written):
        got = [(r.doc_id, r.ids) for r in packing.unpack_documents(table).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    for r in written.collect():
        assert len(r.ids) == 32 and len(r.position_ids) == 32
        assert list(r.position_ids[:: 2]) == packing.position_ids(r.cu_seqlens, 16).tolist()
    none = packing.pack_documents(nothing, RANKS, P.PATTERN, 0)
    assert packing.unpack_documents(packing.write_packed(none)).count() == 0


def _expected(turns):
    said = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    learned = "".join(text or "" for role, text in turns if role == "assistant")
    return (
        len(turns),
        hashlib.sha256(said.encode()).hexdigest(),
        len(learned),
        hashlib.sha256(learned.encode()).hexdigest(),
    )


def test_conversations_come_back(spark, sf):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    hard = r"\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", hard), (1, "assistant", hard)]
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, sf).collect()}
    assert got.keys() == turns.keys()
    for conv_id, rows in turns.items():
        r = got[conv_id]
        want = _expected([x[1:] for x in sorted(rows)])
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want


@pytest.mark.parametrize("piece", [1 << 20, 5])
def test_hard_conversations(spark, public, monkeypatch, piece):
    monkeypatch.setattr(chat_format, "PIECE", piece)
    rows = [
        (1, 0, None, "x"), (1, 1, "assistant", None), (1, 1, "assistant", " \n"),
        (1, 2, "ass:ist\\ant", "\\"), (1, 3, "assistant", "\\\\###### </turn></turn>\n"),
        (2, None, "assistant", "é́한 </turn"), (None, 1, "a", "b"), (3, 1, "assistant", "  lead"),
        (3, 2, "assistant", "trail \n\n"), (3, 2, "assistant", "trail \n\n"), (4, 0, "system", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_format.format_conversations(turns, RANKS, P.PATTERN)
    pieces = defaultdict(list)
    for r in formatted.collect():
        pieces[r.conv_id].append(r)
    assert all([r.piece for r in p] == list(range(len(p))) for p in pieces.values())
    assert len(pieces[3]) == (3 if piece == 5 else 1)
    got = {r.conv_id: r for r in chat_format.read_back(formatted, RANKS, P.PATTERN, in_order=True).collect()}
    shuffled = chat_format.read_back(formatted.repartition(5, "formatted"), RANKS, P.PATTERN)
    assert {r.conv_id: r for r in shuffled.collect()} == got
    for conv_id in (1, 2, 3, 4, None):
        mine = [x[2:] for x in rows if x[0] == conv_id]
        r = got[conv_id]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == _expected(mine)
        text = "".join(p.formatted for p in pieces[conv_id])
        assert chat_format.parse(text) == [(a or "", b or "") for a, b in mine]
        assert len(text) == r.formatted_chars
        # pieces joined are the conversation encoded in one go
        assert [i for p in pieces[conv_id] for i in p.ids] == public.encode_ordinary(text)
    nothing = chat_format.format_conversations(turns.limit(0), RANKS, P.PATTERN)
    assert nothing.count() == 0 and chat_format.read_back(nothing, RANKS, P.PATTERN).count() == 0


def test_conversation_beyond_a_piece_with_a_turn_beyond_it(spark, public):
    long = "word \\ ### é </turn>\n" * 80_000
    rows = [(1, i, ("user", "assistant")[i % 2], said) for i, said in enumerate([long, "a", long, long, "", "z"])]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_format.format_conversations(turns, RANKS, P.PATTERN)
    assert len(long) > chat_format.PIECE and formatted.count() == 4
    (r,) = chat_format.read_back(formatted, RANKS, P.PATTERN).collect()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == _expected([x[2:] for x in rows])
