#: Nulls, empty and odd texts, repeated rows, a very long text, and columns that clash with names used inside.
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "One two"),
    (None, "a text without an id, mail a.b@c.example.org"),
    (7, "same words here. " * 30),
    (7, "same words here. " * 30),
    (8, "same words here. " * 30),
    (9, "It's <|endoftext|> über alles!!    Straße x\x1cy é ΑΣ ǅ \U0001f600\n\n\n  end   "),
    (10, "x" * 70_000),
    (11, "word " * 30_000 + "!?" * 5_000 + " \n" * 40_000 + "tail <|endoftext|>" * 3_000),
    (12, "﻿ zero​width 12345 6,7.8"),
]
