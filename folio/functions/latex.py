"""LaTeX sources to clean spoken prose, by one scanner with handlers for commands and environments.

A `Scanner` runs over a source once, from one special character to the next. At a command it asks its table of handlers; a
handler reads arguments (groups are matched beforehand), says what is spoken in their place and where to go on. What no
handler takes stays as it stands, so a table of a few handlers is a pass of its own, and all tables together are `clean()`.
Dropped citations and references leave a mark in the text, by which `mended()` finds the words that lean on them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import rules, speech
from folio.functions.text import MONTHS, arrow_results, mapped

# --- fixed values: names of commands and environments ---------------------------------------------------------------

SECTIONS = ("section", "subsection", "subsubsection")
#: Commands that vanish with their arguments: `o` an optional group, `m` a braced one, `c` a command name.
DROPPED = (
    dict.fromkeys("definecolor".split(), "mmm")
    | dict.fromkeys("newcommand renewcommand providecommand DeclareMathOperator DeclareRobustCommand".split(), "noom")
    | dict.fromkeys("newenvironment renewenvironment".split(), "moomm")
    | dict.fromkeys("color label hspace vspace vphantom eqref pageref ref autoref cref Cref vref url bibitem".split(), "om")
    | dict.fromkeys("hypersetup tikz usetikzlibrary pgfplotsset tikzset caption captionof captionsetup footnote footnotetext marginpar includegraphics".split(), "om")
    | dict.fromkeys("icmlauthor icmltitle icmltitlerunning icmlaffiliation icmlcorrespondingauthor affiliation correspondingauthor altaffiliation".split(), "om")
    | dict.fromkeys("shorttitle shortauthors orcidlink orcid email thanks keywords author title".split(), "om")
    | dict.fromkeys("twocolumn".split(), "o")
    | dict.fromkeys("addtocontents".split(), "mm")
    | dict.fromkeys("addcontentsline contentsline".split(), "mmm")
    | dict.fromkeys("centering vrule".split(), "")
)
DEFINITIONS = ("newcommand", "renewcommand", "providecommand", "DeclareMathOperator", "DeclareRobustCommand", "newenvironment", "renewenvironment", "def", "gdef", "edef", "let")
CITING = ("eqref", "pageref", "ref", "autoref", "cref", "Cref", "vref")
#: Layout commands, which take the rest of their line with them.
LINE_COMMANDS = frozenset(
    """maketitle tableofcontents printbibliography bibliographystyle bibliography listoffigures listoftables newpage clearpage cleardoublepage vfill hfill
    noindent medskip bigskip smallskip hypertarget tightlist pagestyle thispagestyle fancyhf lfoot rfoot lhead rhead cfoot chead printindex glsaddall
    printglossary itemsep parsep topsep partopsep labelsep leftmargin setlength setcounter addtocounter icmlsetsymbol icmlkeywords
    printAffiliationsAndNotice DeclareSectionCommand RedeclareSectionCommand columnwidth textwidth linewidth""".split()
)
#: Environments that vanish with what they hold.
FLOATS = ("figure", "figure*", "table", "table*", "longtable", "wrapfigure", "wraptable", "minipage", "icmlauthorlist", "thebibliography", "acks")
FORMULAS = tuple(n + s for n in ("equation", "align", "eqnarray", "multline", "gather") for s in ("", "*")) + ("aligned", "split", "subequations", "dcases", "cases")
CODE = ("tikzpicture", "forest", "pgfpicture", "algorithm", "algorithmic", "algorithmicx", "algorithm2e", "lstlisting", "verbatim", "minted", "Verbatim")
NUMBERED, BULLETS = ("enumerate", "compactenum"), ("itemize", "compactitem", "inparaenum")
ORDINALS = ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth")
#: Commands that give way to their last argument, with the number of those before it.
FORMATTING = dict.fromkeys("textbf emph textit texttt text textrm textsf textsc textsl textup textnormal mathbf mathit mathrm mathsf mathtt mathcal boldsymbol bm".split(), 0) | dict.fromkeys(
    "highlight newterm term ul st underline overline mbox hbox vbox fbox makebox framebox parbox".split(), 0
)
COLOURED = {"textcolor": 1, "colorbox": 1, "fcolorbox": 2}
LINKS = {"href": 1, "hyperref": 0}
#: What symbols are in speech.
SYMBOLS = {"\\ldots": "...", "\\ ": " ", "\\\\": " ", "\\_": " ", "\\#": "", "\\&": " and ", "\\%": " percent", "\\!": "", "\\,": "", "\\;": "", "\\:": "", "\\$": "dollar "}
ABBREVIATIONS = {"e.g.": "for example, ", "i.e.": "that is, ", "cf.": "compare ", "w.r.t.": "with respect to ", "w.l.o.g.": "without loss of generality, "}
MARKS = {"---": ", ", "--": " to ", "``": '"', "''": '"', "`": "'", "~": " "}
IN_SECTION = ("in a later section", "as discussed below", "later in this paper", "as we will see", "in a subsequent section")
SEE_SECTION = ("see a later section", "see below", "see later in this paper", "as we will see", "see a subsequent section")
#: Characters of float placements and of column specifications, and those that numeric markers have between their numbers.
PLACEMENTS, COLUMNS, BETWEEN_NUMBERS = "htbpH!", "lcr|p", ",; \t\n\r\x0b\x0c"
#: Units of lengths.
UNITS = ("ex", "em", "pt", "cm", "mm", "in", "sp", "bp", "pc")
#: Characters before an abstract or section that are worth cutting; macro texts that are expanded are shorter than the other.
LEAST_FRONT, LONGEST_MACRO = 50, 100

#: Stands where a citation or reference was.
GONE = "\ue000"

# --- the scanner ----------------------------------------------------------------------------------------------------

# Each begins with one set of characters, for which the engine looks without trying a match at every place.
_SPECIAL = re.compile(r"[\\{}%$](?:(?<=\\)(?:[a-zA-Z@]+\*?|[\s\S])|(?<=\$)\$?|(?<=[{}%]))")
_DELIMITER = re.compile(r"[\\{}](?:(?<=\\)[\s\S]|(?<=[{}]))")
_BRACKET = re.compile(r"\\[\s\S]|[\[\]{}]")

#: (scanner, command without backslash and star, place after it) -> (what is spoken, place to go on), or None to leave it.
Handler = Callable[["Scanner", str, int], "tuple[str, int] | None"]


class Scanner:
    """One run over a source. Groups that are never closed run to its end."""

    def __init__(self, text: str, commands: dict[str, Handler] | None = None, environments: dict[str, Handler] | None = None, default: Handler | None = None, verbatim: bool = True):
        self.text, self.commands, self.environments, self.default, self.verbatim = text, commands or {}, environments or {}, default, verbatim
        self.at_close: dict[int, str] = {}  # a group's last place -> what is spoken there in place of the brace
        self.lists: list[int | None] = []  # items so far of the open numbered lists, None for bullets
        self._ends: dict[int, int] = {}
        self._opened: list[int] = []
        self._delimiters = _DELIMITER.finditer(text)

    def group(self, at: int) -> int:
        """The place after the braced group that opens at `at`. Groups are matched once, as far as one is asked for."""
        while at not in self._ends and (m := next(self._delimiters, None)):
            if m[0] == "{":
                self._opened.append(m.start())
            elif m[0] == "}" and self._opened:
                self._ends[self._opened.pop()] = m.end()
        return self._ends.get(at, len(self.text))

    def bracket(self, at: int) -> int:
        """The place after the bracketed group that opens at `at`; braces inside are passed over whole."""
        depth, here = 0, at
        while m := _BRACKET.search(self.text, here):
            here = m.end()
            if m[0] == "{":
                here = self.group(m.start())
            elif m[0] in "[]":
                depth += 1 if m[0] == "[" else -1
                if not depth:
                    return here
        return len(self.text)

    def blank(self, at: int) -> int:
        """The place after blanks, but not across an empty line."""
        end = at
        while end < len(self.text) and self.text[end].isspace():
            end += 1
        return end if self.text.count("\n", at, end) < 2 else at

    def arguments(self, at: int, kinds: str) -> tuple[list[str], int]:
        """The braced arguments after `at` as `kinds` asks (o, m, n: a name in braces or bare), and the place after them."""
        found = []
        for kind in kinds:
            to = self.blank(at)
            if kind == "o" and self.text[to : to + 1] == "[":
                at = self.bracket(to)
            elif kind in "mn" and self.text[to : to + 1] == "{":
                at = self.group(to)
                found.append(self.text[to + 1 : at - 1] if self.text[at - 1 : at] == "}" else self.text[to + 1 : at])
            elif kind == "n" and (m := re.compile(r"\\[a-zA-Z@]+").match(self.text, to)):
                at = m.end()
        return found, at

    def first(self, command: str) -> str | None:
        """The braced argument of the first use of a command, or None."""
        if "\\" + command not in self.text:
            return None
        for m in re.finditer(rf"\\{command}(?![a-zA-Z@])\*?", self.text):
            if found := self.arguments(m.end(), "om")[0]:
                return found[0]
        return None

    def uses(self, command: str) -> list[str]:
        """The braced arguments of all uses of a command."""
        if "\\" + command not in self.text:
            return []
        places = (m.end() for m in re.finditer(rf"\\{command}(?![a-zA-Z@])\*?", self.text))
        return [found[0] for at in places if (found := self.arguments(at, "om")[0])]

    def starts_line(self, at: int) -> bool:
        return not self.text[self.text.rfind("\n", 0, at) + 1 : at].strip()

    def run(self) -> str:
        """The text as spoken."""
        out, at, text = [], 0, self.text
        while m := _SPECIAL.search(text, at):
            out.append(text[at : m.start()])
            token, at = m[0], m.end()
            if token[0] == "\\" and token[1:].rstrip("*").isalpha():
                said = self._command(token, m.start(), at)
            elif handler := self.commands.get(token):
                said = handler(self, token, at)
            elif token == "}" and m.start() in self.at_close:
                said = self.at_close.pop(m.start()), at
            else:
                said = None
            if said is None:
                said = (token if self.verbatim else "" if token in "{}" else token[1:] if token[0] == "\\" else token), at
            out.append(said[0])
            at = said[1]
        return "".join(out) + text[at:]

    def _command(self, token: str, start: int, at: int) -> tuple[str, int] | None:
        name = token[1:].rstrip("*")
        if name in ("begin", "end"):
            found, after = self.arguments(at, "m")
            handler = self.environments.get(found[0] if found else "") or self.environments.get("")
            self.tag_at = start
            return handler(self, name + " " + (found[0] if found else ""), after) if handler and found else None
        handler = self.commands.get(name) or self.default
        self.tag_at = start
        return handler(self, name, at) if handler else None

    def opened(self, at: int, close: str = "") -> int:
        """Enter the group that opens at `at`: its braces give way to nothing before and `close` behind."""
        self.at_close[self.group(at) - 1] = close
        return at + 1


# --- handlers -------------------------------------------------------------------------------------------------------


def _drop(kinds: str, said: str = "") -> Handler:
    return lambda s, name, at: (said, s.arguments(at, kinds)[1])


def _keep(before: int) -> Handler:
    """The last of before + 1 arguments stays (and is scanned on), those before go."""

    def handler(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
        to = s.blank(s.arguments(at, "o" + "m" * before)[1])
        return ("", s.opened(to)) if s.text[to : to + 1] == "{" else None

    return handler


def _cite(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
    while s.text[at : at + 1] == "[":
        at = s.bracket(at)
    return (GONE, s.group(at)) if s.text[at : at + 1] == "{" else None


def _definition(s: Scanner, name: str, at: int) -> tuple[str, int]:
    """\\def and its kin: a name, parameters, a body in braces or another name."""
    m = re.compile(r"\s*\\[a-zA-Z@]+(?:#\d)*\s*=?\s*(\\[a-zA-Z@]+)?").match(s.text, at)
    if not m:
        return "", at
    end = m.end()
    return "", s.group(end) if not m[1] and s.text[end : end + 1] == "{" else end


def _rest_of_line(s: Scanner, name: str, at: int) -> tuple[str, int]:
    end = s.text.find("\n", at)
    return "", len(s.text) if end < 0 else end + 1


def _comment(s: Scanner, name: str, at: int) -> tuple[str, int]:
    end = s.text.find("\n", at)
    return "", len(s.text) if end < 0 else end


def _to_end(s: Scanner, name: str, at: int) -> tuple[str, int]:
    return "", len(s.text)


def _whole_environment(s: Scanner, tag: str, at: int) -> tuple[str, int] | None:
    """An environment that goes with all it holds, to the first end of its name."""
    what, name = tag.split(" ", 1)
    end = s.text.find(f"\\end{{{name}}}", at) if what == "begin" else -1
    return ("", end + len(name) + 6) if end >= 0 else None


def _display(close: str) -> Handler:
    def handler(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
        end = s.text.find(close, at)
        return ("", end + len(close)) if end >= 0 else None

    return handler


_THANKS = re.compile(r"(?i)acknowledge?ment|authors?\s+contribution")
_NEXT_SECTION = re.compile(r"\\section(?![a-zA-Z])|\\appendix(?![a-zA-Z])")
_NEXT_HEADING = re.compile(r"\\(?:sub)*section(?![a-zA-Z])|\\paragraph(?![a-zA-Z])")


def _back_matter(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
    """Sections of thanks go up to the next section, a section Appendix takes all that follows."""
    found, _ = s.arguments(at, "om")
    title = found[0] if found else ""
    if name == "section" and title.strip().lower() in ("appendix", "appendixes", "appendices"):
        return _to_end(s, name, at)
    if not _THANKS.search(title):
        return None
    after = (_NEXT_HEADING if name == "paragraph" else _NEXT_SECTION).search(s.text, at)
    return "", after.start() if after else len(s.text)


def _heading(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
    to = s.blank(s.arguments(at, "o")[1])
    return ("\n\n", s.opened(to, ".\n\n")) if s.text[to : to + 1] == "{" else None


def _either(*handlers: Handler) -> Handler:
    """The first handler that takes the command."""
    return lambda s, name, at: next((said for h in handlers if (said := h(s, name, at)) is not None), None)


def _tagged(begin: str, end: str) -> Handler:
    return lambda s, tag, at: (begin if tag.startswith("begin") else end, at)


def _abstract_command(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
    to = s.blank(at)
    return ("\n\nAbstract.\n\n", s.opened(to)) if s.text[to : to + 1] == "{" else None


def _list(s: Scanner, tag: str, at: int) -> tuple[str, int] | None:
    """Tags of lists count at the start of a line only."""
    if not s.starts_line(s.tag_at):
        return None
    what, name = tag.split(" ", 1)
    if what == "end":
        if s.lists:
            s.lists.pop()
        return "", at
    s.lists.append(0 if name in NUMBERED else None)
    return "", _rest_of_line(s, name, at)[1]


def _item(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
    if not s.starts_line(s.tag_at):
        return None
    after = s.blank(s.arguments(at, "o")[1])
    if not s.lists or s.lists[-1] is None:
        return "", after
    s.lists[-1] += 1
    n = s.lists[-1]
    return f"{ORDINALS[n - 1] if n <= len(ORDINALS) else f'{n}th'}, ", after


def _other_tag(s: Scanner, tag: str, at: int) -> tuple[str, int]:
    return "", s.arguments(at, "o")[1] if tag.startswith("begin") else at


def _greek(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
    return (f" {speech.GREEK_NAMES[name]} ", at) if name in speech.GREEK_NAMES else None


def _inline(close: str) -> Handler:
    def handler(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
        end = s.text.find(close, at)
        return (speech.speak_inline(s.text[at:end]), end + len(close)) if end > at else None

    return handler


def _accent(s: Scanner, name: str, at: int) -> tuple[str, int] | None:
    """An accent over a letter, braced or not; a letter of its own."""
    name = name.lstrip("\\")
    if name in speech.LETTERS:
        return speech.LETTERS[name], s.group(at) if s.text[at : at + 2] == "{}" else at
    if name.isalpha() and s.text[at : at + 1] not in ("{", " "):
        return None
    m = re.compile(r"\{(\w)\}|\s*(\w)").match(s.text, at)
    return (speech.accented(name, m[1] or m[2]), m.end()) if m else None


def _unknown(s: Scanner, name: str, at: int) -> tuple[str, int]:
    """Any other command: its braced argument stays, by itself it is a blank; family names decide first."""
    if name.startswith("cite"):
        return _cite(s, name, at) or (" ", at)
    return ("", s.opened(at)) if s.text[at : at + 1] == "{" else (" ", at)


def _family(prefix: str, handler: Handler) -> Handler:
    return lambda s, name, at: handler(s, name, at) if name.startswith(prefix) else None


_CITATIONS: dict[str, Handler] = {n: _cite for n in CITING} | {n: _keep(k) for n, k in LINKS.items()} | {"url": _drop("m")}
_BACK: dict[str, Handler] = {n: _back_matter for n in (*SECTIONS, "paragraph")} | {"appendix": _to_end, "bibitem": _to_end}
_DEFINING: dict[str, Handler] = {n: _drop(DROPPED[n]) for n in DEFINITIONS if n in DROPPED} | {n: _definition for n in ("def", "gdef", "edef", "let")}
NON_PROSE: dict[str, Handler] = (
    {n: _drop(k) for n, k in DROPPED.items() if n not in CITING and n != "url"} | _DEFINING | {n: _rest_of_line for n in LINE_COMMANDS} | {n: _keep(k) for n, k in COLOURED.items()} | _BACK | {"%": _comment}
)
NON_PROSE_TAGS: dict[str, Handler] = {n: _whole_environment for n in (*FLOATS, *FORMULAS, *CODE)}
_HEADINGS: dict[str, Handler] = {n: _heading for n in (*SECTIONS, "paragraph")} | {"abstract": _abstract_command}
STRUCTURE: dict[str, Handler] = _HEADINGS | {"item": _item}
STRUCTURE_TAGS: dict[str, Handler] = {n: _list for n in (*NUMBERED, *BULLETS)} | {"abstract": _tagged("\n\nAbstract.\n\n", "\n\n"), "example": _tagged("\n\nFor example:\n", "\n\n"), "": _other_tag}
MATH: dict[str, Handler] = {"$": _inline("$"), "$$": _display("$$"), "\\[": _display("\\]"), "\\(": _inline("\\)"), "\\$": lambda s, n, at: ("dollar ", at)}
WRAPPERS: dict[str, Handler] = {n: _keep(k) for n, k in FORMATTING.items()}
_LETTERS: dict[str, Handler] = {n if n.isalpha() else "\\" + n: _accent for n in (*speech.ACCENTS, *speech.LETTERS)}
_SPOKEN_SYMBOLS: dict[str, Handler] = {(n[1:] if n[1:].isalpha() else n): (lambda s, name, at, said=said: (said, at)) for n, said in SYMBOLS.items()}
_BOTH = {n: _either(_back_matter, _heading) for n in (*SECTIONS, "paragraph")}
_ALL = _LETTERS | _SPOKEN_SYMBOLS | WRAPPERS | MATH | {n: _greek for n in speech.GREEK_NAMES} | STRUCTURE | NON_PROSE | _CITATIONS | _BOTH
_ALL_TAGS = STRUCTURE_TAGS | NON_PROSE_TAGS

# --- passes ---------------------------------------------------------------------------------------------------------


def expand_macros(text: str) -> str:
    """Macros without arguments whose text is short and plain (after one layer of formatting) are replaced, thrice over for chains."""
    if "\\gradientRGB" in text:
        text = Scanner(text, {"gradientRGB": lambda s, n, at: ((a := s.arguments(at, "mmm"))[0][0] if a[0] else "", a[1])}).run()
    known: dict[str, str] = {}
    for m in re.finditer(r"\\(?:new|renew|provide)command(?![a-zA-Z])\*?", text):
        s = Scanner(text)
        found, end = s.arguments(m.end(), "mm")
        name = found[0].strip() if len(found) == 2 else ""
        if not re.fullmatch(r"\\[a-zA-Z]+", name):
            continue
        for form in (found[1].strip(), Scanner(found[1].strip(), WRAPPERS).run()):
            form = form.removesuffix("\\xspace").strip()
            if form and len(form) < LONGEST_MACRO and "\\" not in form:
                known[name[1:]] = form
                break
    if known:
        use = re.compile(r"\\(" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?![a-zA-Z])")
        for _ in range(3):
            text = use.sub(lambda m: known[m[1]], text)
    return text


def body_of(text: str) -> str:
    """What stands between begin and end of the document, else all; an abstract command of the preamble comes first."""
    begin = text.find("\\begin{document}")
    if begin < 0:
        return text
    end = text.find("\\end{document}", begin)
    abstract = Scanner(text[:begin]).first("abstract")
    return (f"\\begin{{abstract}}{abstract}\\end{{abstract}}\n" if abstract else "") + text[begin + 16 : end if end >= 0 else len(text)]


_FRONT = re.compile(r"\\begin\{abstract\}|\\abstract\s*\{|\\(?:sub)*section\*?\{")


def from_abstract(text: str) -> str:
    """The text from its abstract or first section on, if more than LEAST_FRONT characters come before."""
    found = _FRONT.search(text)
    return text[found.start() :] if found and found.start() > LEAST_FRONT else text


def from_abstract_column(text: Column) -> Column:
    """from_abstract() in whole-stage code."""
    at = F.regexp_instr(text, F.lit(rules.java(_FRONT.pattern)))
    return F.when(at > LEAST_FRONT + 1, F.substring(text, at, F.char_length(text))).otherwise(text)


def without_definitions(text: str) -> str:
    """The text without command and environment definitions."""
    return Scanner(text, _DEFINING).run()


def without_non_prose(text: str) -> str:
    """Comments, definitions, colours, back matter, metadata, floats, display formulas, code, notes and layout are dropped."""
    return Scanner(text, NON_PROSE, NON_PROSE_TAGS).run()


def spoken_lists(text: str) -> str:
    """Items of numbered lists get ordinal words, others stand alone."""
    return Scanner(text, {"item": _item}, {n: _list for n in (*NUMBERED, *BULLETS)}).run()


def spoken_structure(text: str) -> str:
    """Headings become sentences of their own, lists are spoken, other environment tags go."""
    return Scanner(text, STRUCTURE, STRUCTURE_TAGS).run()


_BLANKS, _BLANKS_TABS = re.compile("  +"), re.compile(r"[ \t]+")


def _single(text: str, blanks: re.Pattern) -> str:
    """The text with runs of blanks as one, looked for only where there are any."""
    return blanks.sub(" ", text) if "  " in text or "\t" in text else text


def paragraphs(text: str) -> str:
    """Each paragraph on one line, blank ones dropped."""
    joined = (_single(p.replace("\n", " "), _BLANKS).strip() for p in re.split(r"\n\n+", text))
    return "\n\n".join(p for p in joined if p)


def without_citations(text: str) -> str:
    """Citations and references go, with the words that lean on them."""
    return mended(Scanner(text, _CITATIONS, default=_family("cite", _cite)).run())


def spoken_math(text: str) -> str:
    """Dollar amounts are words, display formulas go, inline formulas are spoken."""
    return Scanner(text, MATH).run()


def without_formatting(text: str) -> str:
    """Formatting commands give way to what they hold, at any depth."""
    return Scanner(text, WRAPPERS).run()


_KINDS = r"(?:figures?|figs?\.?|tables?|eqs?\.?|equations?|sections?|secs?\.?|appendi(?:x|ces)|algorithms?)"
_LEANING = re.compile(rf"(?i)(?:\b(in|see|from|at|by|of)[ ~]+)?(?:\b({_KINDS})[ ~]*)?{GONE}(?:[ ~]*(?:,|;|and|or|to|[-–])?[ ~]*(?:{_KINDS}[ ~]*)?{GONE})*")
_EMPTY_ASIDE = re.compile(r"[(\[][\s,;]*(?:(?:see(?: also)?|compare|for example|that is|e\.g\.|i\.e\.|cf\.)[\s,;]*)*[)\]]", re.IGNORECASE)
#: Punctuation that dropped words leave side by side: what is looked for first, the pattern, what becomes of it.
_CLOSING_UP = [
    (re.compile(seek), re.compile(pattern), said)
    for seek, pattern, said in (
        (r",\s*,", r",(?:\s*,)+", ","), (r"\.\s*\.", r"(?<!\.)\.\s*\.(?!\.)", "."), (r"[!?;:]\s*[.,]", r"([!?;:])\s*[.,]", r"\1"),
        (r"\(\s*,", r"\(\s*,\s*", "("), (r",\s*[.)]", r",\s*(?=[.)])", ""),
    )
]


def _blanks_closed_up(text: str) -> str:
    """Runs of white space but line feeds as one blank, none before punctuation."""
    lines = []
    for line in text.split("\n"):
        words = " ".join(line.split())
        lines.append((" " if line[:1].isspace() else "") + words + (" " if words and line[-1:].isspace() else ""))
    text = "\n".join(lines)
    for mark in ".,;:!?)":
        text = text.replace(" " + mark, mark)
    return text


def _without_gone(text: str, instead: Callable[[re.Match], str]) -> str:
    """_LEANING.sub(), tried from the two words before each mark on, where alone a match can begin."""
    out, at = [], 0
    while (gone := text.find(GONE, at)) >= 0:
        start = gone
        for _ in range(2):
            while start > at and text[start - 1] in " ~":
                start -= 1
            while start > at and text[start - 1] not in " ~":
                start -= 1
        m = _LEANING.search(text, start)
        out += text[at : m.start()], instead(m)
        at = m.end()
    return "".join(out) + text[at:]


def mended(text: str) -> str:
    """The words around dropped references: a section that was named becomes a phrase (they take turns), other leaning words
    and empty brackets go, punctuation closes up."""
    used = 0

    def instead(m: re.Match) -> str:
        nonlocal used
        lead, kind = (m[1] or "").lower(), (m[2] or "").lower()
        if not kind.startswith("sec") or lead not in ("in", "see"):
            return ""
        used += 1
        phrases = SEE_SECTION if lead == "see" else IN_SECTION
        return phrases[(used - 1) % len(phrases)]

    text = _blanks_closed_up(_EMPTY_ASIDE.sub("", _without_gone(text, instead)))
    for seek, pattern, said in _CLOSING_UP:
        if seek.search(text):
            text = pattern.sub(said, text)
    return text


_MARKS = sorted({**ABBREVIATIONS, **MARKS}, key=len, reverse=True)
_REVIEWER_DASHES = re.compile(r"-\d{4}-\d{4}-\d{3}")
_REVIEWER_ID = re.compile(r"\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b")


@cache
def _marks_pattern(marks: tuple[str, ...]) -> re.Pattern:
    """Abbreviations are words of their own: no end of a longer one, nor the beginning of an address."""
    return re.compile("|".join(rf"(?<!\w){re.escape(k)}(?![\w.+-]{{0,64}}@)~?,?\s*" if k in ABBREVIATIONS else re.escape(k) for k in marks))


def _specifies(inner: str) -> bool:
    """Whether a bracket's text is a float placement, a column specification or numbers; other brackets are prose."""
    if not inner:
        return False
    numbers = inner[0].isdigit() and inner[-1].isdigit() and not inner.translate({ord(c): None for c in "0123456789" + BETWEEN_NUMBERS})
    return numbers or not inner.strip(PLACEMENTS) or not inner.strip(COLUMNS)


def without_specifications(text: str) -> str:
    """The text without brackets that specify a layout or hold numbers."""
    head, *pieces = text.split("[")
    out = [head]
    for piece in pieces:
        inner, closed, rest = piece.partition("]")
        out.append(rest if closed and _specifies(inner) else "[" + piece)
    return "".join(out)


def without_specifications_column(text: Column) -> Column:
    """without_specifications() in whole-stage code."""
    pieces = F.split(text, r"\[")
    digits = "0123456789"

    def rest_of(piece: Column) -> Column:
        inner = F.substring_index(piece, "]", 1)
        only = lambda chars: F.translate(inner, chars, "") == ""
        at_ends = F.instr(F.lit(digits), F.left(inner, F.lit(1))) * F.instr(F.lit(digits), F.right(inner, F.lit(1))) > 0
        specifies = (inner != "") & F.contains(piece, F.lit("]")) & (only(PLACEMENTS) | only(COLUMNS) | only(digits + BETWEEN_NUMBERS) & at_ends)
        return F.when(specifies, F.substr(piece, F.char_length(inner) + 2)).otherwise(F.concat(F.lit("["), piece))

    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(rest, rest_of), ""))


def spoken_marks(text: str) -> str:
    """Abbreviations and typographic marks in words; reviewers' ids and bracketed specifications go."""
    if marks := tuple(k for k in _MARKS if k in text):
        text = _marks_pattern(marks).sub(lambda m: MARKS.get(m[0]) or ABBREVIATIONS[m[0].rstrip().rstrip(",").rstrip("~")], text)
    if _REVIEWER_DASHES.search(text):
        text = _REVIEWER_ID.sub("", text)
    return without_specifications(text)


def normalized(text: str) -> str:
    """Accents, symbols and abbreviations as spoken; leftover commands, braces and dangling references are removed."""
    plain = Scanner(text, _LETTERS | _SPOKEN_SYMBOLS | _CITATIONS, default=_unknown, verbatim=False).run()
    return mended(spoken_marks(plain).replace("$", ""))


def _is_length(line: str) -> bool:
    """Whether a line is a number and a unit, with commas and blanks around them."""
    length = line.strip(" \t,.")
    return length.endswith(UNITS) and length[:-2].removeprefix("-").replace(".", "", 1).isdigit()


def finalized(text: str) -> str:
    """Blank lines, lines of stray punctuation or a length, and repeated headings are cleared."""
    out: list[str] = []
    for line in text.split("\n"):
        line = _single(line, _BLANKS_TABS)
        if line.strip() and not line.strip().strip(".,;:–-") or _is_length(line):
            continue
        if not line.strip() and (not out or not out[-1].strip()):
            continue
        heading = len(line) < 64 and line[:1].isupper() and line.endswith(".")
        if heading and len(out) >= 2 and out[-2] == line and not out[-1].strip():
            out.pop()
            continue
        out.append(line if line.strip() else "")
    return "\n".join(out).strip()


def clean_body(body: str) -> str:
    """The body of a document as spoken prose: one scan with all handlers, then paragraphs and the words around references."""
    said = Scanner(body, _ALL, _ALL_TAGS, _unknown, verbatim=False).run()
    return finalized(mended(spoken_marks(paragraphs(said))))


def clean(text: str) -> str:
    """A LaTeX document as spoken prose."""
    return clean_body(from_abstract(body_of(expand_macros(text))))


# --- metadata -------------------------------------------------------------------------------------------------------

_INLINE = _ALL | {n: _drop("om") for n in ("thanks", "footnote", "inst", "orcid")} | {"$": _display("$")}


def inline_text(text: str) -> str:
    """A title or name without markup."""
    return re.sub(r"[\s~]+", " ", Scanner(text, _INLINE, default=_unknown, verbatim=False).run()).strip()


def authors_of(text: str) -> list[str]:
    """Author names in order, once each: of icml commands, of several author commands, or of one with separators. Names
    with an at sign or of 80 characters or more are left out."""
    uses = Scanner(text).uses
    names = [inline_text(a) for a in uses("icmlauthor")]
    if not names:
        raw = uses("author")
        if len(raw) == 1:
            raw = re.split(r"\\(?:and|AND)(?![a-zA-Z])", raw[0])
        names = [n for n in map(inline_text, raw) if "@" not in n and len(n) < 80]
    return list(dict.fromkeys(n for n in names if n))


def metadata(text: str, stem: str = "", no_title: str = "Untitled", no_author: str | None = None) -> dict:
    """title (with subtitle; no_title if none), date (of the preamble, else of an id in the file name), authors (no_author if none)."""
    source = Scanner(text)
    get = lambda name: inline_text(source.first(name) or "")
    title = ": ".join(p for p in (get("title"), get("subtitle")) if p) or get("icmltitle") or no_title
    preamble = text.split("\\begin{document}", 1)[0] if "\\begin{document}" in text else text[:3000]
    date = inline_text(Scanner(preamble).first("date") or "")
    if not any(c.isdigit() for c in date) and not any(m.lower() in date.lower() for m in MONTHS):
        found = re.search(r"(\d{2})(\d{2})\.\d{4,5}", stem)
        date = f"{MONTHS[int(found[2]) - 1]} {2000 + int(found[1])}" if found and 1 <= int(found[2]) <= 12 else ""
    return {"title": title, "date": date, "authors": authors_of(text) or ([no_author] if no_author else [])}


# --- columns --------------------------------------------------------------------------------------------------------

_SPOKEN = "body string, title string, date string, authors array<string>"


def spoken(df: DataFrame, text_col: str = "text", stem_col: str | None = None) -> DataFrame:
    """df with struct column `spoken` (body, title, date, authors) of each LaTeX text; null for null. One narrow stage, no shuffle."""

    kind = pa.struct([("body", pa.string()), ("title", pa.string()), ("date", pa.string()), ("authors", pa.list_(pa.string()))])

    def one(text: str | None, stem: str | None) -> dict:
        if text is None:
            return {}
        known = expand_macros(text)
        return {"body": clean_body(from_abstract(body_of(known))), **metadata(known, stem or "")}

    @F.arrow_udf(_SPOKEN)
    def run(texts: pa.Array, stems: pa.Array) -> pa.Array:
        return arrow_results((one(text.as_py(), stem.as_py()) for text, stem in zip(texts, stems, strict=True)), kind)

    return df.withColumn("spoken", run(F.col(text_col), F.col(stem_col) if stem_col else F.lit("")))


def passed(text: Column, step: Callable[[str], str]) -> Column:
    """One of the passes as a column; null for null. Nested groups are beyond regular expressions, so it runs in Python, by Arrow batches."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return mapped(texts, step)

    return run(text)
