"""A score doesn't grow with the length of a clean document."""

from notegrain.llm import toxicity


def test_long_clean_documents_stay_clean():
    bias, weights = -8.6, {"vile": 12.0, "odd": 6.0, "kind": -3.0}
    clean = "A kind word. Plain words here. An odd thing. " + "Nothing to see. " * 60
    assert toxicity.sentence_scores(clean, bias, weights)[0] < 0.1
    for times in (1, 70, 1600):  # up to 100,000 sentences
        assert toxicity.sentence_scores(clean * times, bias, weights)[0] < toxicity.THRESHOLD
    value, offending = toxicity.sentence_scores(clean * 100 + "You vile one. " + clean * 100, bias, weights)
    assert value >= toxicity.THRESHOLD and len(offending) == 1
    # sentences near each other still add up
    assert toxicity.sentence_scores("An odd thing. " * 50, bias, weights)[0] >= toxicity.THRESHOLD
    assert toxicity.sentence_scores(None, bias, weights) == (0.0, [])
