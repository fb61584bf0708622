"""Rows that every operator must stand."""

ODD = [
    (None, "a text without an id that says a few things"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (6, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (7, "word " * 30000), (8, "word " * 30000), (8, "word " * 30000), (9, "é ü ß x y 中文"),
    (9, "another text of the same id"), (10, "!!! ??? ... ###"), (11, "x" * 70000),
]
