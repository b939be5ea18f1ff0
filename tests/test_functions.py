import pytest
from pyspark.sql import functions as F

from folio.functions import latex, pdf, scripts, speech
from folio.functions import text as T
from folio.sources import archives


@pytest.mark.parametrize(
    "formula, words",
    [
        ("x^2", "x squared"), (r"a \leq b", "a less than or equal to b"), (r"\frac{a}{b}", "a over b"), (r"\sqrt{x}", "the square root of x"), (r"\sqrt[3]{x}", "the 3th root of x"),
        (r"27^{th}", "27th"), (r"x_{12}", "x"), (r"x_{ij}", "x sub ij"), (r"\sum x", "the sum of x"), (r"A^T", "A transpose"), (r"\log n", "log of n"),
    ],
)
def test_speak(formula, words):
    assert speech.speak(formula) == words


def test_complexity_gates_inline_math():
    assert speech.complexity(r"\frac{a}{b}^2_1") == 4
    assert speech.speak_inline("x") == " x "
    assert speech.speak_inline(r"\frac{1}{2}" * 5) == ""


def test_accents_and_greek():
    assert speech.accents(r"Erd\H{o}s G\"odel na\"{i}ve \aa{} Stra\ss{}e \v{c} \'{x}") == "Erdős Gödel naïve å Straße č x"
    assert speech.greek(r"$\alpha_\varepsilon$").split() == ["$", "alpha", "_", "epsilon", "$"]


def test_arguments_nest_and_run_to_the_end():
    source = r"x\title[s]{A {B} C}y\author{open {"
    assert latex.Scanner(source).first("title") == "A {B} C"
    assert latex.Scanner(source, {"title": latex.NON_PROSE["title"]}).run() == r"xy\author{open {"
    assert latex.Scanner(source, {"author": latex.NON_PROSE["author"]}).run() == r"x\title[s]{A {B} C}y"
    assert latex.Scanner(r"\authors{a}").first("author") is None


def test_macros():
    text = latex.expand_macros(r"\newcommand{\ours}{\textbf{Name}\xspace}\newcommand{\long}{\frac{1}{2}} \ours{} \oursx \long")
    assert "Name{}" in text and r"\oursx" in text and text.endswith(r"\long")


SOURCE = r"""\documentclass{a}\title{A \emph{Great} Paper}\subtitle{Sub}\author{Ann\and Bob\and a@b.c}
\begin{document}\maketitle
\begin{abstract}We study \cite{x} things~\citep[e.g.][]{k}. It costs \$5.\end{abstract}
\section{Introduction}
First line % hidden
goes on; see there.

\begin{itemize}
\item dot
\end{itemize}
\begin{enumerate}
\item one
\item two
\end{enumerate}
\begin{figure}\includegraphics{f.png}\caption{Cap {x}}\end{figure}
\begin{equation}a=b\end{equation} \[ c \] $$ d $$ Done \textbf{\emph{now}} [1] \url{http://x.y}.
\section{Acknowledgments} thanks
\appendix hidden
\begin{thebibliography}{9}\bibitem{x} y\end{thebibliography}\end{document}"""


def test_clean_leaves_no_artifacts():
    out = latex.clean(SOURCE)
    for gone in ("\\", "bibitem", "hidden", "thanks", "[1]", "http", "$", "{", "Cap", "a=b"):
        assert gone not in out, gone
    assert out.startswith("Abstract.\n\n") and "Introduction." in out and "First, one Second, two" in out and "dollar 5" in out and "Done now" in out
    assert latex.metadata(SOURCE, "2403.12345v1") == {"title": "A Great Paper: Sub", "date": "March 2024", "authors": ["Ann", "Bob"]}


def test_elements_survive_all_passes():
    body, elements = scripts.extract_elements(latex.body_of(SOURCE))
    assert [e.element_id for e in elements] == ["FIGURE_001", "DISPLAY_MATH_001", "DISPLAY_MATH_002", "DISPLAY_MATH_003"]
    assert elements[0].caption == "Cap x" and elements[0].figures == ("f.png",)
    for step in (latex.without_non_prose, latex.spoken_structure, latex.paragraphs, latex.without_citations, speech.greek, latex.spoken_math, latex.without_formatting, latex.normalized, latex.finalized):
        body = step(body)
    assert all(scripts.PLACEHOLDER + e.element_id in body for e in elements)
    assert [scripts.formula_of(e.source) for e in elements[1:]] == ["a=b", "c", "d"]
    long = SOURCE.replace("First line", "First line " + "word " * 60)
    told = scripts.hybrid(long, lambda es: {e.element_id: f"<{e.element_id}>" for e in es})
    assert "<FIGURE_001>" in told and "a equals b" in told and scripts.PLACEHOLDER not in told


def test_descriptions_are_split_by_id():
    got = scripts.parse_descriptions("FIGURE_001: one\ntwo\nDISPLAY_MATH_002: **three**", ["FIGURE_001", "DISPLAY_MATH_002", "TABLE_001"])
    assert got == {"FIGURE_001": "one\ntwo", "DISPLAY_MATH_002": "three"}


def test_model_artifacts():
    raw = "\\(x\\) **b** *i* see \\ref{a} reference sec:model \\ours\nI'm sorry, I cannot.\nThis concludes the section.\nreference designs"
    assert scripts.without_model_artifacts(raw) == "x b i see  \u0020ours\n\nreference designs"
    assert "designs" not in scripts.without_model_artifacts(raw, strict=False)
    said = scripts.without_model_artifacts
    assert said("in Table cref, the ~ref~fig:x end; see reference fig:a_b. A ***c*** 2 * 3 * 4 **open") == "in Table , the  end; see . A c 2  3  4 **open"
    assert said("the reference work\\begin{align*}a\\end{align*}\\begin{itemize}") == "the reference worka" + "begin{itemize}"
    assert said("a\nThat wraps up our talk.\nThis ends here. But this goes on.\nI am sorry, no.\nThis concludes.") == "a\n\nThis ends here. But this goes on.\n\nThis concludes."
    assert scripts.caption_of("\\caption[s]{A \\textbf{b \\emph{c}} \\label{x}\\alpha}") == "A b c \\alpha"
    assert scripts.formula_of("\\begin{align*}\\label{q}a &= b \\\\ c\\nonumber\\end{align*}") == "a  = b   c" and scripts.formula_of("$$ x $$") == "x" and scripts.formula_of("\\begin{x}") == "\\begin{x}"
    assert scripts.macro_table("\\newcommand{\\x}{\\ensuremath{\\textsc{Y}}\\xspace}\\newcommand*{\\y}[1][a]{b}\\newcommand\\z{c}\\providecommand{\\q}{\\alpha}\\newcommand{\\q}{r}") == [("x", "Y"), ("y", "b")]
    assert latex.without_specifications("a[ht][lc|r] [1, 2;3] [x] [] [1,] [[2]") == "a  [x] [] [1,] ["
    assert scripts.macro_table(r"\newcommand{\a}{\textbf{X}}\renewcommand{\a}{Y}\newcommand{\b}[1]{\foo #1}") == [("a", "X")]


PDF = "A Very Good Title\nAuthor One\n\nAbstract\nWe pre-\nsent a result that\nis joined [1,2] e.g. here.\narXiv:2103.1 x\n12\n1.5 2 3\nFigure 1: gone\n\nMore prose. " + "Word and word. " * 20 + "\nReferences\n[1] gone"


def test_pdf(spark):
    df = spark.createDataFrame([(1, PDF, "A Very Good Title"), (2, "short", "A"), (3, None, None), (4, PDF, None)], "id long, t string, title string")
    got = {r["id"]: r["s"] for r in df.select("id", pdf.spoken(F.col("t"), F.col("title")).alias("s")).collect()}
    assert got[2] is None and got[3] is None and "Author One" in got[4]
    out = got[1]
    assert out.startswith("Abstract") and "present a result that is joined for example, here." in out
    for gone in ("arXiv", "Figure 1", "gone", "1.5", "Author One"):
        assert gone not in out


def test_line_classes(spark):
    lines = {
        "arXiv:2103.1 [cs]": "stamp", "Smith et al.": "running head", "∗ equal": "footnote", "- 12 -": "page number", "3.2.1": "section number", "Table 2: x": "caption",
        "Authors' addresses: A": "address", "https://x.y": "data", "1.5 2% x 3": "data", "": "blank", "A line of prose 12.": "prose", "Figure skating": "prose",
    }
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    assert {r[0]: r[1] for r in df.select("t", pdf.line_class(F.col("t"))).collect()} == lines
    text = "x" * 500 + " The Old Good Title a the old good title b\nAuthors' addresses: one\ntwo, three\nNext."
    r = spark.createDataFrame([(text,)], "t string").select(pdf.without_running_title(F.col("t"), F.lit("The Old Good Title")).alias("r"), pdf.without_artifacts(F.col("t")).alias("a")).first()
    assert "Old Good" not in r["r"].replace("The Old", "") and r["a"].endswith("b\nNext.")


@pytest.mark.parametrize(
    "text, most, want",
    [("short", 100, ["short"]), ("a" * 50 + "\n\n" + "b" * 50, 60, ["a" * 50, "b" * 50]), ("", 10, []), ("  \n\n ", 10, []), ("x" * 200, 100, ["x" * 200]), ("a\n\nb\n\nc", 4, ["a\n\nb", "c"]), ("aa\n\nb\n\nc", 4, ["aa", "b\n\nc"])],
)
def test_chunks(spark, text, most, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.chunks(F.col("t"), most).alias("c")).first()["c"] == want


def test_native_columns(spark):
    df = spark.createDataFrame([("see 2103.12345v2 or astro-ph/9903245", "x &amp;lt; <b>y</b> $z$ \\alpha &#65;")], "a string, h string")
    r = df.select(T.paper_id(F.col("a")), T.import_ids(F.col("a")), T.strip_html(F.col("h")), T.feed_date(F.lit("on 7 Mar 2024")), T.feed_date(F.lit("none")), T.spoken_date(F.lit("2024-03-07")), T.spoken_date(F.lit("March")), T.id_date(F.lit("2403.12345")), T.id_date(F.lit("x"))).first()
    assert list(r) == ["2103.12345", ["2103.12345", "astro-ph/9903245"], "x < y z α A", "2024-03-07", "none", "March 7, 2024", "March", "March 2024", ""]


def test_sections_and_scripts(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, "no markup at all")], "id long, t string")
    parts = df.select("id", scripts.sections(F.col("t")).alias("s")).orderBy("id").collect()
    assert parts[0]["s"][0].startswith("\\begin{abstract}") and len(parts[0]["s"]) == 3 and parts[1]["s"] == ["no markup at all"]
    full = {r["id"]: r for r in scripts.full_script(df, "id", "t", lambda p, n: p.upper()).collect()}
    assert full[1]["chunks"] == 3 and full[2]["script"] == "NO MARKUP AT ALL"


def test_latex_column(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, "")], "id long, text string")
    out = {r["id"]: r["spoken"] for r in latex.spoken(df).collect()}
    assert out[1]["body"] == latex.clean(SOURCE) and out[2]["body"] is None and out[3]["body"] == ""


def test_archives(spark, tmp_path):
    import io
    import tarfile

    files = {"main.tex": "\\documentclass{a}\\begin{document}\\input{Sec/one}\\input{gone}% \\input{no}\n\\end{document}", "sec/one.tex": "ONE \\input{sec/one}", "f.png": "x"}
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    found = archives.read_archives(spark, str(tmp_path))
    assert sorted(r[0] for r in found.select(archives.is_pdf(F.col("content"))).collect()) == [False, True]
    texts = [r["text"] for r in archives.latex_texts(archives.members(found)).collect()]
    assert None in texts and any(t and "ONE " in t and "% \\input{no}" in t and "gone" not in t for t in texts)


GOLDEN = r"""\begin{abstract}
A new way to sort stones.
\end{abstract}

\section{Start}
Stones vary. Figure~\ref{fig:heap} shows a heap.

\begin{figure}[ht]
\centering
\includegraphics[width=3cm]{pics/heap.v2}
\caption[short]{A heap of \emph{many \textbf{stones}}.}
\label{fig:heap}
\end{figure}

\section{How}
A stone weighs
\begin{align}
w &= \rho v \label{eq:w} \\
v &= a^3 \nonumber
\end{align}
and its sum is $$s = 1$$ while \[ t_{0} = 2 \] holds.

\begin{algorithm}
\caption{Sort}
\begin{algorithmic}
\STATE $x \leftarrow 1$
\end{algorithmic}
\end{algorithm}

\begin{table*}
\caption{Weights.}
\begin{tabular}{lc}
Stone & Weight \\
\end{tabular}
\end{table*}

\section{End}
Stones are sorted."""


def test_a_golden_document():
    body, elements = scripts.extract_elements(GOLDEN)
    assert [(e.element_id, e.caption, e.figures) for e in elements] == [
        ("FIGURE_001", "A heap of many stones.", ("pics/heap.v2",)), ("TABLE_001", "Weights.", ()), ("ALGORITHM_001", "Sort", ()),
        ("DISPLAY_MATH_001", "", ()), ("DISPLAY_MATH_002", "", ()), ("DISPLAY_MATH_003", "", ()),
    ]
    assert [" ".join(scripts.formula_of(e.source).split()) for e in elements[3:]] == [r"w = \rho v v = a^3", "t_{0} = 2", "s = 1"]
    assert elements[0].context == "" and elements[3].context.endswith("A stone weighs")
    assert not any(x in body for x in ("includegraphics", "align", "algorithmic", "tabular", "rho", "$$"))
    said = latex.clean_body(body)
    assert said.split("\n\n") == [
        "Abstract.", "A new way to sort stones.", "Start.", "Stones vary. shows a heap.", "HYBRID_ELEMENT_FIGURE_001", "How.", "A stone weighs", "HYBRID_ELEMENT_DISPLAY_MATH_001", "and its sum is",
        "HYBRID_ELEMENT_DISPLAY_MATH_003", "while", "HYBRID_ELEMENT_DISPLAY_MATH_002", "holds.", "HYBRID_ELEMENT_ALGORITHM_001", "HYBRID_ELEMENT_TABLE_001", "End.", "Stones are sorted.",
    ]
    plain = latex.clean(GOLDEN)
    assert plain.split("\n\n")[-2:] == ["End.", "Stones are sorted."] and "holds." in plain and "w &" not in plain and "Weights" not in plain
