"""Mathematics to spoken words, accents to Unicode."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spoken operators, in the order in which they are replaced.
OPERATORS = [
    ("+", " plus "), ("-", " minus "), ("\\times", " times "), ("\\cdot", " times "), ("\\cdots", "..."), ("\\ldots", "..."), ("\\div", " divided by "),
    ("=", " equals "), ("\\neq", " does not equal "), ("\\ne", " does not equal "), ("\\approx", " approximately equals "), ("\\sim", " approximately "),
    ("\\simeq", " is similar to "), ("\\equiv", " is equivalent to "), ("\\leq", " less than or equal to "), ("\\le", " less than or equal to "),
    ("\\geq", " greater than or equal to "), ("\\ge", " greater than or equal to "), ("<", " less than "), (">", " greater than "),
    ("\\ll", " much less than "), ("\\gg", " much greater than "), ("\\in", " in "), ("\\notin", " not in "), ("\\subset", " is a subset of "),
    ("\\subseteq", " is a subset of "), ("\\supset", " is a superset of "), ("\\cup", " union "), ("\\cap", " intersection "), ("\\pm", " plus or minus "),
    ("\\mp", " minus or plus "), ("\\to", " to "), ("\\rightarrow", " to "), ("\\leftarrow", " from "), ("\\Rightarrow", " implies "),
    ("\\Leftarrow", " is implied by "), ("\\iff", " if and only if "), ("\\forall", " for all "), ("\\exists", " there exists "), ("\\neg", " not "),
    ("\\land", " and "), ("\\lor", " or "), ("\\infty", " infinity "), ("\\partial", " partial "), ("\\nabla", " nabla "), ("\\propto", " is proportional to "),
    ("\\perp", " perpendicular to "), ("\\parallel", " parallel to "), ("\\mid", " given "), ("\\|", " norm of "),
    ("\\left", ""), ("\\right", ""), ("\\Big", ""), ("\\big", ""), ("\\bigg", ""), ("\\Bigg", ""),
]
#: Spoken functions, sums, powers.
FUNCTIONS = [
    ("\\sin", "sine"), ("\\cos", "cosine"), ("\\tan", "tangent"), ("\\log", "log"), ("\\ln", "natural log"), ("\\exp", "e to the power of"), ("\\max", "max"),
    ("\\min", "min"), ("\\sup", "supremum"), ("\\inf", "infimum"), ("\\lim", "limit"), ("\\arg", "arg"), ("\\det", "determinant"), ("\\dim", "dimension"),
    ("\\mod", "mod"), ("\\gcd", "greatest common divisor"), ("\\Pr", "probability"),
]
TOTALS = {"sum": " the sum of ", "prod": " the product of ", "int": " the integral of "}
POWERS = {
    "2": " squared", "3": " cubed", "T": " transpose", "t": " at time t", "*": " star", "'": " prime", "\\prime": " prime", "-1": " inverse",
    "n": " to the n", "k": " to the k", "i": " to the i", "\\circ": " degrees", "\\dagger": " dagger", "\\dag": " dagger",
}
ORDINAL_ENDINGS = ("th", "st", "nd", "rd")
#: Greek commands whose spoken name differs from the command; all others are spoken as they are written.
GREEK = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega").split()
GREEK_VARIANTS = {"varepsilon": "epsilon", "vartheta": "theta", "varpi": "pi", "varrho": "rho", "varsigma": "sigma", "varphi": "phi"}
#: Accent commands as combining marks with the letters they apply to, and letters of their own.
ACCENTS = {
    "'": ("\u0301", "aeiouyAEIOUYcnszCNSZlLrR"), "`": ("\u0300", "aeiouAEIOU"), "^": ("\u0302", "aeiouAEIOUcghjsw"), '"': ("\u0308", "aeiouyAEIOUY"),
    "~": ("\u0303", "anoANO"), "c": ("\u0327", "cCsStT"), "=": ("\u0304", "aeiouAEIOU"), "H": ("\u030b", "ouOU"), ".": ("\u0307", "zZcgI"),
    "d": ("\u0323", "aeiou"), "r": ("\u030a", "aAuU"), "u": ("\u0306", "agAGu"), "v": ("\u030c", "cszrneCSZRNEdtDT"), "k": ("\u0328", "aeAE"),
}
LETTERS = {"aa": "å", "AA": "Å", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ"}
#: Inline formulas above this complexity are left out; display formulas above the other go to a describer.
MOST_COMPLEX, MOST_SPOKEN = 8, 6
#: Characters of a braced index that is spoken as one.
LONGEST_INDEX = 10


GREEK_NAMES = {g: g for g in GREEK} | GREEK_VARIANTS
_GREEK_COMMAND = r"\\(" + "|".join(sorted(GREEK_NAMES, key=len, reverse=True)) + r")(?![a-zA-Z])"


def greek(text: str) -> str:
    """Greek commands as English names, set off by blanks."""
    return re.sub(_GREEK_COMMAND, lambda m: f" {GREEK_NAMES[m[1]]} ", text)


def greek_column(text: Column) -> Column:
    """greek() in whole-stage code: variants take their letter's name first, then all names are set off."""
    for variant, name in GREEK_VARIANTS.items():
        text = F.regexp_replace(text, rf"\\{variant}(?![a-zA-Z])", rf"\\{name}")
    return F.regexp_replace(text, _GREEK_COMMAND, " $1 ")


def accented(accent: str, letter: str) -> str:
    """A letter with an accent; one that does not take it stays bare."""
    mark, letters = ACCENTS[accent]
    return unicodedata.normalize("NFC", letter + mark) if letter in letters else letter


def accents(text: str) -> str:
    """Accent commands, braced or not, and special letters as Unicode; an accent a letter does not take is dropped."""
    for name in sorted(LETTERS, key=len, reverse=True):
        text = re.sub(rf"\\{name}(?:\{{\}}|(?=[^a-zA-Z]|$))", LETTERS[name], text)

    for pattern in (r"\\(['\"`^~.=])\{(\w)\}", r"\\([cHdruvk])\{(\w)\}", r"\\(['\"`^~.=])(\w)", r"\\([cHdruvk])([a-zA-Z])(?!\w)"):
        text = re.sub(pattern, lambda m: accented(m[1], m[2]), text)
    return text


def complexity(formula: str) -> int:
    """How hard a formula is to speak."""
    weights = ((r"\\frac", 2), (r"\\(?:sum|prod|int)", 2), (r"\\begin\{", 3), (r"\^", 1), (r"_", 1))
    return sum(w * len(re.findall(p, formula)) for p, w in weights) + max(0, len(formula) - 50) // 20


_STYLES = frozenset("displaystyle textstyle scriptstyle scriptscriptstyle".split())
_SIZES = frozenset("left right big Big bigg Bigg".split())
_WORDS = {name.removeprefix("\\"): said for name, said in OPERATORS} | {name.removeprefix("\\"): f" {said} of " for name, said in FUNCTIONS} | TOTALS | {n: f" {g} " for n, g in GREEK_NAMES.items()}
_FORMULA_TOKEN = re.compile(r"\\[a-zA-Z]+|\\[\s\S]|\s+|[\s\S]")
#: Nested groups that are parsed; deeper ones are read as they stand.
DEEPEST = 60


class _Formula:
    """A formula as a sequence of tokens, read once from left to right; groups are read by recursion."""

    def __init__(self, text: str):
        self.tokens, self.at = _FORMULA_TOKEN.findall(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def blanks(self) -> None:
        while self.peek().isspace():
            self.at += 1

    def raw(self, pair: str) -> str | None:
        """The source of a group, if one opens here."""
        self.blanks()
        if self.peek() != pair[0]:
            return None
        begin, depth = self.at + 1, 0
        while self.at < len(self.tokens):
            depth += {pair[0]: 1, pair[1]: -1}.get(self.take(), 0)
            if not depth:
                return "".join(self.tokens[begin : self.at - 1])
        return "".join(self.tokens[begin:])

    def argument(self, depth: int) -> str | None:
        """What a braced group says, or None."""
        inner = self.raw("{}")
        return None if inner is None else _words(inner, depth + 1).strip()


def _power(formula: _Formula, depth: int) -> str:
    inner = formula.raw("{}")
    if inner is None:
        sign = formula.take() if formula.peek() else ""
        bare = POWERS.get(sign) or (_words(sign, depth + 1) if sign[:1] == "\\" else sign)
        return bare if sign in POWERS else f" to the {bare.strip()}" if sign[:1].isalnum() or sign[:1] == "\\" else "^" + sign
    inner = inner.strip()
    if unwrapped := re.fullmatch(r"\\(?:text|math)[a-z]*\s*\{([^{}]*)\}", inner):
        inner = unwrapped[1].strip()
    return inner if inner in ORDINAL_ENDINGS else POWERS.get(inner) or f" to the power of {_words(inner, depth + 1).strip()}"


def _index(formula: _Formula, depth: int) -> str:
    inner = formula.raw("{}")
    if inner is None:
        sign = formula.take() if formula.peek() else ""
        return f" sub {_words(sign, depth + 1).strip()}" if sign[:1].isalnum() or sign[:1] == "\\" else "_" + sign
    if re.fullmatch(r"\s*\d{1,2}\s*", inner) or not inner:
        return ""
    said = _words(inner, depth + 1).strip()
    return f" sub {said}" if len(inner) <= LONGEST_INDEX else f"_{said}"


def _words(text: str, depth: int = 0) -> str:
    """A formula, or a part of one, in words with loose blanks."""
    if depth > DEEPEST:
        return re.sub(r"\\[a-zA-Z]+|[{}\\]", " ", text)
    formula, out = _Formula(text), []
    while token := formula.peek():
        formula.at += 1
        name = token[1:] if token[0] == "\\" else token
        if token == "^":
            out.append(_power(formula, depth))
        elif token == "_":
            out.append(_index(formula, depth))
        elif token == "{":
            formula.at -= 1
            out.append(formula.argument(depth))
        elif token == "\\frac":
            above, below = formula.argument(depth), formula.argument(depth)
            out.append(f"{above} over {below}" if above is not None and below is not None else above or "")
        elif token == "\\sqrt":
            degree, inner = formula.raw("[]"), formula.argument(depth)
            out.append(f"the {_words(degree, depth + 1).strip()}th root of {inner or ''}" if degree else f"the square root of {inner or ''}")
        elif token[0] == "\\" and name in _STYLES:
            continue
        elif token[0] == "\\" and name in _SIZES:
            if formula.peek() in (*".()[]|", "\\|", "\\{", "\\}"):
                formula.at += 1
        elif name in _WORDS and (token[0] == "\\" or not name.isalpha()):
            out.append(_WORDS[name])
        else:
            out.append(" " if token[0] == "\\" and name.isalpha() else "" if token == "}" else name)
    return "".join(out)


def speak(formula: str) -> str:
    """A formula in words."""
    return " ".join(_words(formula).split())


def speak_inline(formula: str) -> str:
    """An inline formula: short names as they are, words if not too complex, else nothing."""
    formula = formula.strip()
    if re.fullmatch(r"[a-zA-Z0-9]{1,3}", formula):
        return f" {formula} "
    return "" if complexity(formula) > MOST_COMPLEX else f" {speak(formula)} "
