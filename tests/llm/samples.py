"""Texts for the fixtures."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, syllables=("the", "an", "re", "ing", "tion", "ou", "ha", "be", "st")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
