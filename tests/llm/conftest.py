import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, n int, hash string, ids int, batch string"

EN = "The quick brown fox jumps over the lazy dog while the old farmer watches from the gate and thinks about the weather of the coming week"
FR = "Le vieux renard brun saute par dessus le chien paresseux pendant que le fermier regarde depuis la porte et pense au temps de la semaine"


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, EN, "en", "a"), (1, EN, "en", "a"), (2, FR, "fr", "a"), (3, None, "en", "b"), (4, "", None, None), (5, "  \n\t ", "fr", "b"),
        (None, EN + " again", "en", None), (None, None, None, None), (6, "12 34 ### !!", "en", "a"), (7, ("word " * 30_000).strip(), "en", "b"), (8, "x" * 200_000, "en", "b"),
        (9, "Ünïcödé 漢字 😀   <|endoftext|> ½²", "fr", "a"), (10, "a", "en", "a"), (11, "mail a.b@c.example.com now", "en", "a"), (12, FR, "fr", "c"), (13, "\x00\x1c�", None, "c"),
    ]
    return spark.createDataFrame([(i, t, la, so, len(t or ""), 5, 6, "h", 7, "b") for i, t, la, so in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """A maker of pronounceable text from a seed: the same words for the same seed."""
    import random

    def make(seed: int, n: int, syllables: str = "ba be bi do du fa fe ga gi ka ko la le lu ma mi na no pa pe ra ri sa so ta ti va vo za zu") -> str:
        rng, parts = random.Random(seed), syllables.split()
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make
