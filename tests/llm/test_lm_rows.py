import numpy as np

from weftline.llm import maxent_lm as lm


def test_frequent_words_have_rows_and_histories_of_their_own():
    """The 3,072 most frequent words are told apart as context, alone and in pairs."""
    words = [b"%dsame" % k for k in range(3072)]  # one ending, so hashed rows would be one
    encoder = lm.Encoder({w: k for k, w in enumerate(words)})
    row = lm.unpack(encoder.codes(words))[2]
    assert len(np.unique(row)) == len(words)
    found = lm.histories(row, np.arange(len(row)) == 0)
    assert len(np.unique(found)) == len(words)
    assert len(np.unique(lm.features(found)[:, 2])) > 2048
