"""Tables and brute force for the operators' tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def prose(seed: int, words: int, stems: str = "en") -> str:
    rng = random.Random(seed)
    parts = {"en": ["th", "er", "ing", "and", "ou", "st"], "fr": ["eau", "é", "qu", "ion", "le", "ç"]}[stems]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)
