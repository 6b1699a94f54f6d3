"""Every text of a batch goes through the library, also late ones that bring no new segment."""

import pytest
from notegrain.llm import piece_bpe


@pytest.mark.parametrize("texts", [["the", "cat"], ["the " * 60_000, "a cat sat"]])
def test_late_texts_of_known_segments_are_verified(texts):
    vocabulary = piece_bpe.MergeVocabulary(piece_bpe.model_bytes())
    for part in ("ids", "odd"):
        known = piece_bpe.SegmentTable(vocabulary)
        right = list(piece_bpe.encode_batch(known, [*texts, None, texts[1]]))
        theirs = [vocabulary.library.encode(t) for t in [*texts, "", texts[1]]]
        assert right == [(",".join(map(str, i)), vocabulary.library.decode(i)) for i in theirs]
        getattr(known, part)[" cat"] = "5"
        with pytest.raises(AssertionError, match="otherwise"):
            list(piece_bpe.encode_batch(known, texts))
