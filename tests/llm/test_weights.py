"""The cap on labelled rows must not change what a score means."""

import pytest

from telemetra.llm import quality, toxicity


@pytest.mark.parametrize(("module", "label", "usual"), [(quality, "quality", 1), (toxicity, "toxic", 0)])
def test_capped_fit_keeps_the_share_of_a_label(spark, module, label, usual):
    texts = ["one two three four", "five six, seven", "eight nine ten!", "eleven twelve"]
    rows = [(i, texts[i % 4], usual if i // 4 % 10 else 1 - usual) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], f"doc_id long, {label} int")
    score = getattr(module, f"score_{label}" if label == "quality" else "score_toxicity")
    whole, capped = ({r.doc_id: r.score for r in score(docs.where("doc_id < 4"), module.train(docs, labels, n)).collect()} for n in (10**6, 100))
    share = 0.9 if usual else 0.1
    assert all(abs(s - share) < 0.06 for s in whole.values()), whole
    assert all(abs(s - share) < 0.12 for s in capped.values()), capped
