"""Small inputs for the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, sid string, th string, score string, row string, t string, h string, k string, e string, fp string, copies string, predicted string, held_out string, lang_pred string, _id string"


def words(rng, n, vocabulary=("the", "of", "and", "to", "in", "that", "was", "for", "is", "on", "with", "as", "by", "at", "from")):
    return " ".join(rng.choice(vocabulary) + rng.choice(("", "ing", "er", "ly", "ation")) for _ in range(n))


def odd_texts():
    return [None, "", " \n\t ", "one", "one two three", "!!! ??? ###", "äöü ß € 漢字 😀", "x" * 5000, words(random.Random(3), 30_000), "a\x00b\x1fc d　e"]


def frame(spark, rows, clash=False):
    """rows: (doc_id, text, lang) or (doc_id, text)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    if not clash:
        return spark.createDataFrame(full, SCHEMA)
    extra = CLASH.count(",") + 1 - 5
    return spark.createDataFrame([r + (7,) * 0 + tuple(None for _ in range(extra)) for r in full], CLASH)


def odd_frame(spark, clash=True):
    """Odd texts, a repeated row, a repeated id and a null id."""
    rows = list(enumerate(odd_texts()))
    return frame(spark, [*rows, rows[4], (5, "another text of id five"), (None, "no id here")], clash)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
