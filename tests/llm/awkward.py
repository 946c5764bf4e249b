"""Texts that operators must bear."""

AWKWARD = [
    "",
    None,
    " ",
    "\n\n\n",
    "a",
    "x" * 5000,
    "ab " * 4000,
    "no blanks here" * 300,
    "Under the MIT license. Under the  MIT-license! apache license version 2.0 cc-by-nc cc by nc",
    "tab\tand\x00nul\x1cseparators wide   spaces  end ",
    "日本語のテキスト" * 40,
    "naïve café ÀÉÎ\nline\nline\nline\nline",
    "naïve café ÀÉÎ\nline\nline\nline\nline",
    "'s 't 're I'll don't 12345 !!! ???\r\n\r\n  x",
]
