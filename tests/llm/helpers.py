"""Small documents with the cases every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, fp long, node long, h long"
EXTRA = ("r", "k", 1, 2, 3)

LONG = "word%d " * 20_000 % tuple(range(20_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "One two three, four five six seven eight nine ten.", "en", "a", 50),
    (5, "One two three, four five six seven eight nine ten.", "en", "b", 50),
    (5, "One two three, four five six seven eight nine ten.", "en", "b", 50),
    (6, LONG, "en", "b", len(LONG)),
    (7, "Ünïcode «text» with 数字 and ١٢٣ and <|endoftext|> inside. End of İt ΣΑΣ.", "de", "c", 60),
    (None, "a row without a number", None, "c", 22),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def empty(spark):
    return documents(spark, [])
