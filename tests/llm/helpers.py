import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def docs(spark, rows, more="extra struct<id:int,text:string>"):
    """documents with a null or two, and columns whose names the operators use inside."""
    full = [(*r, None, "x", 1, (1, "t"), 2.0, "k", 5) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {more}, score double, key string, n long")


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a b c d"), (6, "A B C D"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "no id here"), (8, "a b c d e f"), (9, "é" * 3000 + " " + "word " * 3000), (10, "x" * 200_000), (11, "  a  b c\n\n\na b c "), (12, "😀 ​ ünï"),
]
