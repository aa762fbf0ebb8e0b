"""Rows with nulls, empty, short, repeated and odd texts."""
ODD_ROWS = [(None, None), (None, "no id at all but six words"), (1, None), (2, ""), (3, "one"),
            (3, "one"), (4, " \n\t "), (5, "a b c d"), (6, "A B c D"), (7, "é ü ß \x01 \x85 x y")]
