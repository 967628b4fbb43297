"""Random words for small corpora."""

WORDS = [a + b for a in ("ba", "ko", "ti", "re", "mu", "sha") for b in ("n", "lo", "der", "s", "vik", "")]


def make_text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
