"""Long words of one pattern must not be taken for each other."""

import numpy as np
import pyarrow as pa
import pytest

from papyrine.llm import decontamination, jaccard_join, kernels, packing


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


@pytest.fixture(params=[1024, 4096])
def pair(request):
    return thue_morse(request.param, "ab"), thue_morse(request.param, "ba")


def test_hashes_differ(pair):
    buffer = kernels.text_buffer(pa.array([*pair, pair[0].upper()]))
    lower, exact = kernels.hash_words(*buffer).hashes, kernels.hash_words(*buffer, lower=False).hashes
    assert lower[0] != lower[1] and lower[0] == lower[2] and len(set(exact.tolist())) == 3


def test_tokenizer_ids(pair):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    reference, encoder = Tokenizer.from_file(path), packing.WordEncoder(path, 1 << 20)
    texts = [*pair, " ".join(pair), "plain words"]
    ids, counts = encoder.batch(*kernels.text_buffer(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_is_bounded_by_bytes():
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 60_000)
    for i in range(20):
        encoder.batch(*kernels.text_buffer(pa.array([" ".join(f"w{i}x{j}" for j in range(300))])))
        assert encoder.size() <= 60_000
    encoder.batch(*kernels.text_buffer(pa.array([" ".join(f"v{j}" for j in range(9000))])))
    assert encoder.size() == 0


def test_no_link_and_no_leak(spark, pair):
    tail = " one two three four five"
    docs = spark.createDataFrame([(1, pair[0] + tail), (2, pair[1] + tail), (3, pair[0])], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.link_components(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 3}
    items = spark.createDataFrame([(7, pair[1])], "item_id long, text string")
    leaks = decontamination.find_leaks(docs.where("doc_id = 3"), items, keep_clean=False)
    assert leaks.count() == 0
