"""Documents with nulls, empty, repeated, long and odd texts."""

LONG = "Long words go on and on, é 中文 12.5! " * 4000

ODD = [
    (1, "One two three four five."),
    (1, "One two three four five."),
    (2, None),
    (3, ""),
    (None, "nobody's text is still a text, isn't it"),
    (4, " \t\n\x0b\x0c\r "),
    (5, LONG),
    (6, "x" * 5000),
    (7, None),
    (7, "tie tie tie tie"),
    (8, "tie tie tie tie"),
]
