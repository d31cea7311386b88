"""Small tables that operators must get through: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

CLASHING = "key node mark root size n bin place row_hash source_key __block __slot __id __keep id_as_text gone_id".split()
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, score string, fp string, lane string, words string, " + ", ".join(f"{c} string" for c in CLASHING) + ", `a.b` string, `doc_id.text` string, `tick``s` string"


def rows(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "the", "THE", "über", "naïve", "!!", "###", " x"]

    def text(k):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n"]) for _ in range(k))

    out = [(i, text(rng.randrange(0, 90)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), i) for i in range(n)]
    shared = text(45)
    out += [(n + i, f"{text(5)}{shared} {text(5)}", "en", "a", None) for i in range(6)]
    out += [(n + 10 + i, out[i % 4][1], None, "b", 1) for i in range(12)]  # copies
    out += [out[3], out[3], out[-1]]  # repeated rows
    out += [(None, "a text without an id", "en", None, None), (n + 30, None, "en", "a", 0), (n + 31, "", None, None, 0), (n + 32, " \n\t ", "de", "c", 3), (n + 33, "123 !? 456", "en", "c", 3)]
    out += [(n + 34, ("again and again\n" * 400) + text(20_000), "en", "long", 9), (n + 35, "one", "en", "c", 3), (n + 36, " ", "en", "c", 1)]
    out += [(n + 37, "x " * 300, "en", "c", 3), (n + 38, "x " * 299, "en", "c", 3)]
    return [(*r, 7, "clash", None, "x", "y", *CLASHING, "dot", "dots", None) for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SHAPE)


def empty(spark):
    return spark.createDataFrame([], SHAPE)
