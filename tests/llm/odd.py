"""Texts that every operator must take: null, empty, blank, without letters, accents, very long, repeated."""

ODD = [None, "", " \t\n", "12 34 --", "Éa ñ ß", "word " * 30_000, "x" * 60_000, "same text here", "same text here"]
