"""HTML -> flat element and string arrays, with the standard library's tokenizer.

The tree is built without repairs: no implied end tags, an end tag closes up to the nearest open
element of that name, an unmatched one is ignored, void elements close themselves. Comments and
declarations are not text, nor is the content of scripts, styles, templates and ruby notes.
"""

from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql.functions import arrow_udf

from newsmill.schemas import PARSED, PARSED_WITH_OWN

# Elements without content, elements whose strings are not text, elements that
# keep white space as it is, and attributes that hold a list of words.
VOID = set(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split())
NOT_TEXT = {"script", "style", "template", "rt", "rp"}
VERBATIM = {"pre", "textarea"}
WORD_LISTS = {
    "*": {"class", "accesskey", "dropzone"}, "a": {"rel", "rev"}, "link": {"rel", "rev"},
    "td": {"headers"}, "th": {"headers"}, "form": {"accept-charset"}, "object": {"archive"},
    "area": {"rel"}, "icon": {"sizes"}, "iframe": {"sandbox"}, "output": {"for"},
}
BLANK = " \n\t\f\r"
PIECE = 1 << 18  # characters of markup whose pages are held together


class Page(HTMLParser):
    """One parsed page. Element -1 is the document itself."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=False)
        self.tag, self.parent, self.last, self.twin = [], [], [], []
        self.s_from, self.s_to, self.text, self.owner = [], [], [], []
        self._open, self._buffer = [], []
        self._depth = {}   # name -> open elements of that name; pages may nest very deeply
        self._shape = []   # per open element: (name, attributes, children so far)
        self._first = {}   # structure of an element -> position of the first such element
        self.feed(markup)
        self.close()
        self._flush()
        while self._open:
            self._pop()
        self._measure()

    def _measure(self):
        """Text lengths without building any text, which may be far longer than the page."""
        total, self.lines, before, after = [0], [0], [], []
        for run in self.text:
            kept = len(run.strip())
            total.append(total[-1] + len(run))
            self.lines.append(self.lines[-1] + (kept + 1 if kept else 0))
            before.append(len(run) - len(run.lstrip()))
            after.append(len(run) - len(run.rstrip()))
        ahead, behind = [len(self.text)] * (len(self.text) + 1), [-1] * (len(self.text) + 1)
        for i in reversed(range(len(self.text))):
            ahead[i] = ahead[i + 1] if before[i] == len(self.text[i]) else i
        for i, run in enumerate(self.text):
            behind[i + 1] = behind[i] if before[i] == len(run) else i
        self.size = []
        for first, end in zip(self.s_from, self.s_to):
            a, b = ahead[first], behind[end]
            self.size.append(total[b + 1] - total[a] - before[a] - after[b] if a <= b else 0)

    @property
    def own(self):
        """The strings of each element that no element below it holds."""
        held = [[] for _ in self.tag]
        for at, run in zip(self.owner, self.text):
            if at >= 0:
                held[at].append(run)
        return ["".join(runs) for runs in held]

    def _flush(self, kind=None):
        """End the current run of characters; ``kind`` marks runs that are not text."""
        if not self._buffer:
            return
        run = "".join(self._buffer)
        self._buffer.clear()
        if not run.strip(BLANK) and not any(self._depth.get(name) for name in VERBATIM):
            run = "\n" if "\n" in run else " "
        if kind is None and not any(self._depth.get(name) for name in NOT_TEXT):
            self.text.append(run)
            self.owner.append(self._open[-1] if self._open else -1)
        if self._shape:
            self._shape[-1][2].append((kind, run))

    def _pop(self):
        at = self._open.pop()
        name, attributes, children = self._shape.pop()
        self._depth[name] -= 1
        self.last[at] = len(self.tag) - 1
        self.s_to[at] = len(self.text)
        self.twin[at] = self._first.setdefault((name, attributes, tuple(children)), at)
        if self._shape:
            self._shape[-1][2].append(self.twin[at])

    def handle_starttag(self, name, attrs):
        self._flush()
        lists = WORD_LISTS["*"] | WORD_LISTS.get(name, set())
        values = {k: " ".join((v or "").split()) if k in lists else v or "" for k, v in attrs}
        self.tag.append(name)
        self.parent.append(self._open[-1] if self._open else -1)
        self.s_from.append(len(self.text))
        for column in (self.last, self.twin, self.s_to):
            column.append(None)
        self._open.append(len(self.tag) - 1)
        self._depth[name] = self._depth.get(name, 0) + 1
        self._shape.append((name, tuple(sorted(values.items())), []))
        if name in VOID:
            self._pop()

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in VOID:
            self.handle_endtag(name)

    def handle_endtag(self, name):
        self._flush()
        if self._depth.get(name):
            while self.tag[self._open[-1]] != name:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_entityref(self, name):
        self._buffer.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        try:  # a number may also have more digits than int() takes
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            # numbers below 256 are read as Windows-1252, as browsers do
            made = bytes([code]).decode("cp1252") if code < 256 else chr(code)
        except UnicodeDecodeError:
            made = chr(code)
        except (ValueError, OverflowError):
            made = "�"
        # lone surrogates cannot be stored as UTF-8
        self._buffer.append("�" if "\ud800" <= made <= "\udfff" else made)

    def _other(self, data, kind):
        self._flush()
        self._buffer.append(data)
        self._flush(kind)

    def handle_comment(self, data):
        self._other(data, "comment")

    def handle_decl(self, decl):
        self._other(decl, "declaration")

    def handle_pi(self, data):
        self._other(data, "instruction")

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._flush()
            self._buffer.append(data[6:])
            self._flush()
        else:
            self._other(data, "declaration")


def _columns(pages: list, fields) -> pa.Array:
    columns = []
    for field in fields:
        kind = pa.string() if field.name in ("tag", "text", "own") else pa.int32()
        offsets, values = [0], []
        for page in pages:
            if page is not None:
                values.extend(getattr(page, field.name))
            offsets.append(len(values))
        columns.append(pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(values, kind)))
    return pa.StructArray.from_arrays(
        columns, [f.name for f in fields], mask=pa.array([p is None for p in pages]))


def _read(markup: str | None) -> Page | None:
    try:
        return None if markup is None else Page(markup)
    except AssertionError:  # the tokenizer's word for markup it rejects
        return None


def _in_pieces(batches: Iterator[pa.Array], fields) -> Iterator[pa.Array]:
    """Parsed pages of all batches, given out as soon as ``PIECE`` characters are read: a parsed page
    takes many times the memory of its markup, and a batch may hold thousands."""
    for html in batches:
        pages, held = [], 0
        for markup in html:
            markup = markup.as_py()
            pages.append(_read(markup))
            held += len(markup or "")
            if held >= PIECE:
                yield _columns(pages, fields)
                pages, held = [], 0
        if pages:
            yield _columns(pages, fields)


@arrow_udf(PARSED)
def parse(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """STRUCT of parallel arrays for each page; null where there is no page or no way to read it."""
    yield from _in_pieces(html, PARSED)


@arrow_udf(PARSED_WITH_OWN)
def parse_with_own(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same with ``own``."""
    yield from _in_pieces(html, PARSED_WITH_OWN)
