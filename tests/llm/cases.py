"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

WORDS = [f"w{i}" for i in range(400)] + ["Ä", "ß", "l'été", "don't", "12", "***", "|", "…", " x"]


def prose(rng, n, words=WORDS):
    out = []
    for _ in range(n):
        out.append(rng.choice(words))
        out.append(rng.choice([" "] * 12 + ["\n", "\t", "  ", "\n\n"]))
    return "".join(out)


def documents(seed=0, n=40):
    """(doc_id, text) rows with near and exact copies, shared passages and lines."""
    rng = random.Random(seed)
    passage, line = prose(rng, 70), "a line that many documents share\nand a second one"
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([0, 1, 4, 9, 30, 60, 130]))
        if i % 5 == 1:
            text += " " + passage + " " + prose(rng, 5)
        if i % 5 == 2:
            text += "\n" + line + "\n" + prose(rng, 8)
        rows.append((i, text))
    rows += [(n, rows[6][1]), (n + 1, rows[6][1]), (n + 2, rows[11][1].replace("w1 ", "w2 ", 1)),
             (n + 3, prose(rng, 6000)), (n + 4, "x" * 30_000), (n + 5, " \n\t "), (n + 6, ""),
             (n + 7, None), (None, rows[1][1]), (None, None), (n + 8, "same same same same " * 40)]
    return rows + [rows[3], rows[3], rows[1]]


CLASHES = ["piece", "length", "rank", "block", "h", "w", "pos", "fp", "text_key", "shard", "slot",
           "size", "n", "line", "lines", "start", "phrase", "component_id", "law", "place",
           "quality", "line_dedup", "__doc_id", "__id", "__text_key", "__gone", "__longest", "__lines"]


def frame(spark, rows, extra=True):
    columns = "doc_id long, text string" + "".join(
        f", {c} string" for c in CLASHES if extra) + (", lang string, source string, n_chars long" if extra else "")
    data = [(*r, *[None if i % 2 else "x" for i in range(len(CLASHES))], None, "s", len(r[1] or ""))
            if extra else r for r in rows]
    return spark.createDataFrame(data, columns).repartition(3)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]
