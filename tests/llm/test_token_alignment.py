"""Token alignment against a plain alignment of whole texts."""

from bisect import bisect
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from papyrine.llm import queries, token_alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=PATHS[1])
SYMBOL = token_alignment.byte_symbols()


def plain(text):
    """([(A tokens, B tokens)] by group, [links]) of a text tokenised whole, or nothing."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    a = [(i, bytes(SYMBOL[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    ends_a, ends_b = (np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b))
    cuts = sorted(set(ends_a) & set(ends_b))
    groups, ended = [], {c: ([], []) for c in cuts}
    places = [[0] + [bisect(ends, c) for c in cuts] for ends in (ends_a, ends_b)]
    for g in range(len(cuts)):
        groups.append(tuple([i for i, _ in side[at[g] : at[g + 1]]] for side, at in zip((a, b), places, strict=True)))
    for which, (side, ends) in enumerate(((a, ends_a), (b, ends_b))):
        for (i, _), e in zip(side, ends, strict=True):
            if e in ended:
                ended[e][which].append(i)
    return groups, [(i, j) for c in cuts for i in ended[c][0] for j in ended[c][1]]


def expected(rows):
    aligned = [(doc, *plain(text)) for doc, text in rows]
    count = Counter(link for _, _, links in aligned for link in links)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc, groups, links in aligned:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n_a, n_b = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


TEXTS = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\nline\n\nlines \n x", "end. \n", "carriage\r\nreturn\r", "a\xa0b 　 c", "can't I'll", "naïve café — déjà", "日本語 text", "emoji 👩‍🚀 ok",
    "<|endoftext|> and <s> </s> <0x41> <unk>", "under▁score", "▁", "\x00 \x01", "x" * 700, "12345 3.14", "\x0b\x0c v", " lead", "trail ", "def f(x):\n    return {x};\n", "the the the the",
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x0c\xa0abTh.'1é▁語👍", max_size=25) | st.sampled_from([t for t in TEXTS if t]), max_size=4))
def test_units_equal_whole_texts(texts):
    own = token_alignment.aligner(*PATHS, 1 << 20)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    units, row, first = own.batch(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for d, text in enumerate(texts):
        mine = row[first[d] : first[d + 1]]
        groups, links = plain(text)
        if units.bad[mine].any():
            assert not groups
            continue
        assert b";".join(units.groups[mine]).decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        flat = np.concatenate([np.zeros(0, np.int64), *(units.pairs[units.start[u] : units.start[u] + units.n_links[u]] for u in mine)])
        assert [(int(p >> 32), int(p & 0xFFFFFFFF)) for p in flat] == links


def test_cuts_and_links_of_empty_tokens():
    """Tokens of no bytes end where the token before them does: all of a cut link with each other."""
    cuts, group_a, group_b = token_alignment.cut_groups(np.array([2, 4, 4, 7]), np.array([1, 4, 4, 7]))
    assert cuts.tolist() == [4, 7] and group_a.tolist() == [0, 0, 0, 1] and group_b.tolist() == [0, 0, 0, 1]
    a, b = token_alignment.links_at(cuts, np.array([2, 4, 4, 7]), np.array([1, 4, 4, 7]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def _rows():
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    return rows + [(4, "a"), (4, "a"), (None, "the the"), (None, None), (90, "Long text here. " * 3000), (91, "line one\nline two\n" * 50)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, "g") for d, t in _rows()], "doc_id long, text string, n_a int, groups string").repartition(3)


def test_query_equals_plain_alignment(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_token_alignment(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(_rows())


@pytest.mark.parametrize("max_pairs", [0, 3, 40])
def test_pairs_beyond_the_broadcast_bound_meet_their_counts_in_a_join(docs, max_pairs):
    got = token_alignment.align(docs, *PATHS, max_pairs=max_pairs, salts=3).drop("groups")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:7] for r in expected(_rows())), key=repr)


def test_a_small_memo_changes_nothing(docs):
    got = token_alignment.align(docs, *PATHS, memo_bytes=0).drop("groups")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:7] for r in expected(_rows())), key=repr)


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_whole_table_equals_plain_alignment(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_token_alignment(spark, sf_dir).collect()), key=repr) == expected(rows)
