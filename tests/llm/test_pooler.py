"""Words' rows in the toxicity pooler: long words, other spellings, words near no landmark."""

import numpy as np

from oddsmith.llm import toxicity as tox


def test_rows_of_words():
    marks = ["idiot", "moron", "stupid"]
    all_values = tox.Landmarks(marks)
    texts = ["idiot", "IDIOT! i.d.i.o.t", "idiot" * 8 + "moron" * 8, "zzzzzzz", "", None, "q" * 100 + "stupid", "i d i o t"]

    def row(word):
        parts = [p for p in tox.pieces(word) if len(p) >= tox.ORDER]
        v = all_values.kernel(parts)
        v[v < tox.FLOOR] = 0
        return v.max(0)

    for order in (texts, texts[::-1]):
        pooler = tox.Pooler(marks)
        got = {}
        for t in order:  # one at a time: later texts find the rows of earlier ones
            mean, most = pooler.pool([t])
            got[t] = mean[0], most[0]
        for t in texts:
            words = [tox.normal(w) for w in tox.tokens(t or "")]
            values = np.array([row(w) for w in words if len(w) >= tox.ORDER] or [np.zeros(3)])
            assert np.allclose(got[t][0], (values**tox.SHARP).sum(0) / (len(words) + tox.WEIGHT), atol=1e-6)
            assert np.allclose(got[t][1], (values**tox.BLUNT).max(0), atol=1e-6)
        assert all(got[t][1].any() for t in (texts[0], texts[2], texts[7])) and not got["zzzzzzz"][1].any()
