"""Documents with everything that is awkward, for the tests of the operators."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

TEXTS = [
    None, "", " ", "\n", "a", "A b", "  two  spaces ", "tab\tand\r\nlines\x0b\x0c end", "don't we'll I'M",
    "x" * 3000, "word " * 2500, "Été über señor", "日本語 テキスト", "emoji 👩‍👩‍👧 ok", "a b c 　d",
    "\x1c odd \x1d\x1e breaks", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "1234567 89 0", "#$%& *** |||",
    "a\nb\n\n c", "same text", "same text", "same  text ", "nul \x00 byte", "İstanbul K", "_ __ a_b",
]


def documents(spark, texts=TEXTS, first_id=0):
    rows = [(first_id + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """``TEXTS`` with a null and a repeated id, and columns whose names an operator might use itself."""
    rows = [(i, t, None, None, None, "x", 1, 2) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, "x", 1, 2), (3, "\n", None, None, None, "x", 1, 2)]
    rows += [(21, "same text", None, None, None, "x", 1, 2)] * 2
    return spark.createDataFrame(rows, DOCS + ", row string, kept int, facts int")


def empty(spark):
    return spark.createDataFrame([], DOCS)
