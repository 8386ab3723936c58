"""What an encoder's worker holds: each word once, whatever its generation."""

import tracemalloc

import public_tokenizers

from loomgraph.llm import byte_bpe


def test_a_remembered_word_is_held_once():
    own = byte_bpe.Encoder(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q" for i in range(n, n + 1000)) for n in range(0, 10_000, 1000)]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for text, (_, _, raw) in zip(texts, own.spell(texts), strict=True):
        assert raw == text.encode()
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held < 215 * len(own.known)
    assert not own.odd


def test_words_decoded_to_other_bytes_are_kept_apart():
    own = byte_bpe.Encoder(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    list(own.spell(["one two"]))
    assert own.known["one"][1] == b"" and not own.odd
    own.db.execute("update vocabulary set bytes = '-2'::blob where bytes = ' two'::blob")
    assert next(own.spell(["one two three"]))[2] == b"one two three"
    own.known.clear()
    assert next(own.spell(["one two"]))[2] == b"one-2" and own.odd
