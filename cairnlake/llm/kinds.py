"""Kinds of lines in a main body, and groups of tags."""

OWN, REPEATED, NOTICE, PROMPT, DATE, BEFORE, SHARE, BLANK = range(8)
#: Tags that show a sample.
SAMPLES = ("code", "pre", "kbd", "samp", "textarea")
#: Tags of tables and definitions.
CELLS = ("td", "th", "dt", "dd")
#: Tags whose text is a link.
LINKS = ("a", "button")
