"""Small tables with every edge: nulls, empty and long texts, ties, repeated rows, near copies, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = "key long, n long, kind int, bucket int, cid long, gkey long, token long, root long, spans string, items string, ids string, trained string, __row_key long"


#: A few plain texts.
DOCUMENT = ("one short text of a few words, mail a.b@mail.example.com", "the second text goes on for somewhat longer than ten words do, as this one shows", "$$$ ### !!!")


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "to", *(("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8)))) for _ in range(max(4, n // 2)))]
    return " ".join(rng.choice(words) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    edited = base.split()
    edited[7] = "changed"
    far = [w if i % 9 else "x" + w for i, w in enumerate(base.split())]
    texts = [
        None, "", " \t\n ", "one", "Two Words", base, base, base.upper(), " ".join(edited), " ".join(far), f"{prose(rng, 50)} {passage} {prose(rng, 40)}", f"{passage}\n{prose(rng, 30)}", f"{prose(rng, 70)}\t{passage}",
        "a b c d e f", "a b c d e f", "again and again " * 60, "line one here\nline one here\nother line\n\n\nline one here", "ünïcödé ßtraße naïve café ЖЗ 漢字 words   nbsp em \x1c fs \x85 nel \x00 nul",
        "x" * 5000, ("word%d " * 3000) % tuple(range(3000)), prose(rng, 6000), "| a | b | %%% $$$ ### &&& *** <> <|endoftext|> <|startoftext|>it's don't 'LL ...",
        "mail a.b+c@mail.example.com, x@y@z.org or a@b; call +1 (269) 555-3296 or +12; 10.0.0.255 256.1.1.1 1.2.3.4.5; card 4111 1111 1111 1111 4111111111111112; token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" Maria Lopez",
        prose(rng, 200), prose(rng, 36), prose(rng, 35), prose(rng, 34),
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    # Repeated rows, two documents of one id, and rows without one.
    return [*rows, rows[5], (5, "another text of the same id", "en", "src0", 27), (None, base, None, None, None), (None, None, None, None, None), (None, None, None, None, None)]


def benchmark(docs: list[tuple]) -> list[tuple]:
    words = docs[10][1].split()
    return [(1, " ".join(words[55:80])), (2, "two words"), (3, None), (4, ""), (5, "..."), (10, "never seen anywhere at all in this table of documents here"), (2, "ONE!"), (None, "a b c d e f")]


def labels(docs: list[tuple]) -> list[tuple]:
    return [(d[0], int(d[0] % 5 != 0) if d[0] != 3 else None, 0) for d in docs if d[0] is not None][:20] + [(None, 1, 0), (999, 0, 0)]


def frame(spark, rows: list[tuple], clashing: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        for column in CLASHING.split(", "):
            name, kind = column.split(" ")
            df = df.withColumn(name, F.lit("1").cast(kind))
    return df
