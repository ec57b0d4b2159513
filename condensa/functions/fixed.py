"""Formats and word lists that results depend on, kept together as plain text."""

#: Stands where chunks were left out.
MARKER = "[…]"
MORE_ROWS = "# (+%d more rows, %d columns total)"
REPEATED = "%s  (x%d)"
#: White space as Unicode text handling strips it.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Lines that matter in logs: whole words for the batch operator, any place for the stream's sketch.
LOG_WORDS = (
    "error err warn warning fatal critical crit exception traceback fail failed failure panic denied refused timeout unhandled"
).split()
STREAM_WORDS = "error warn critical exception traceback fatal fail".split()
LEVEL_WORDS = "trace debug info warn warning error err fatal critical".split()
#: Elements without article text, and elements that start a new block.
SKIPPED = "script style noscript template svg canvas head nav header footer aside form button".split()
BLOCKS = "p div section article li tr br h1 h2 h3 h4 h5 h6 pre blockquote td th".split()
#: Character references that are common enough to be read by name, the ampersand's last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: How a line of a log begins, strictly (for typing) and when a reader must see it whole (for parsing).
LOG_LINE = r"(?i)^\s*(\d{4}-\d{2}-\d{2}[ t]\d{2}:\d{2}|\[\d{2}:\d{2}:\d{2}\]|(trace|debug|info|warn|warning|error|err|fatal|critical)\b|traceback\(mostrecentcalllast\))"
LOG_PREFIX = r"(?i)^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\s+(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b"
MARKUP = r"(?i)</?(?:script|style|div|span|nav|header|footer|li|ul|a|p)\b"
HTML_TAG = r"<[a-zA-Z/][^>]{0,200}>"
HTML_HINTS = r"<!doctype html|<html[\s>]|<body[\s>]|<div[\s>]|<p[\s>]"
#: BM25 constants, the part of the best score below which records fall off, and sizes in tokens, words and records.
K1, B = 1.5, 0.75
CLIFF = 0.5
CHUNK_TOKENS, CHUNK_WORDS = 200, 40
KEEP_ALL_RECORDS, ID_CHARS, FLAT_MAP, RECORD_MAP = 10, 128, 20, 3
#: Rungs of the JSON ladder: records kept, characters of a string, depth, small lists kept whole.
LADDER = (
    (10, 200, 8, True), (10, 120, 8, True), (10, 60, 8, True), (10, 30, 8, True), (8, 16, 8, True),
    (10, 60, 8, False), (8, 60, 8, False), (6, 60, 8, False), (8, 16, 8, False), (6, 16, 8, False),
    (4, 16, 8, False), (3, 16, 8, False), (2, 16, 8, False), (1, 16, 8, False), (1, 16, 4, False),
    (1, 16, 3, False), (1, 16, 2, False),
)
