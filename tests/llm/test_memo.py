"""What one stage's memo holds is gone before a worker takes a task of another."""

from wirespan.llm.memo import Memo, trimmed


def test_other_stages_forget():
    memo = Memo(lambda words: [w.encode() for w in words])
    assert memo.join([["a", "b", "a"]]) == [b"aba"]
    assert memo.held
    assert list(trimmed(lambda batches: (x for x in batches))([1, 2])) == [1, 2]
    assert (memo.known, memo.held) == ({}, 0)
    assert memo.join([["b", "a"]]) == [b"ba"]


def test_packing_keeps_little_in_a_worker():
    import public_tokenizers

    from wirespan.llm.packing import byte_bpe

    assert byte_bpe(public_tokenizers.path("byte_bpe_50k.json")).memo.limit <= 96 << 20


def test_a_worker_keeps_one_table_of_powers():
    """Whatever the length of the texts that it has shingled."""
    import tracemalloc

    from wirespan.llm.near_dedup import shingles

    shingles(["a b c d e f"])
    tracemalloc.start()
    try:
        shingles(["one two three four five six seven " * 100_000])
        assert tracemalloc.get_traced_memory()[0] < 4 << 20
    finally:
        tracemalloc.stop()
