"""A table with everything that a corpus throws at an operator."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rk long, key string, anchors string, rep int, part int, _tl_rk string"
LONG = " ".join(f"word{i % 977} und der{i % 13}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the dark forest near the old river bank"


def rows():
    def row(i, text, lang="en", source="s"):
        return (i, text, lang, source, None if text is None else len(text), i, "k", None, 1, 2, "x")

    return [
        row(1, PROSE),
        row(2, PROSE),
        row(2, PROSE),  # a repeated row
        row(3, PROSE.replace("lazy", "sleepy")),
        row(4, None),
        row(5, ""),
        row(6, " \n\t "),
        row(7, "?!... --"),
        row(None, PROSE + " again"),
        row(8, "one"),
        row(9, LONG, None),
        row(10, "x" * 200_000, "de", None),
        row(11, "日本語 テキスト 🙂 ▁ é ñ"),
        row(12, "a " * 300),
        (13, "all other columns are null", *[None] * 9),
    ]


def documents(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
