"""Rows that every operator on documents has to stand: nulls, empties, long texts, repeats."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, token string, line string"
LONG = " ".join(f"word{i % 977} and, Ünïcode{i % 13}." for i in range(6000))


def odd_rows():
    texts = [None, "", " \n\t ", "one", "a b c d e f g h i j k l m n o p q r s t u v w x y z", LONG, LONG, "x" * 5000, "'s it's \x1c tab\x0bs İΣΣ ſK <|endoftext|> a<|startoftext|>b ①½ 日本 \u00a0e\u0301", "same\nsame\nsame\n", "same\nsame\nsame\n"]
    rows = [(i, t, None, "src", None, 1, "t", None) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id at all", None, None, None, None, None, None)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
