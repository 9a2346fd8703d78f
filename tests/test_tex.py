r"""LaTeX blocks of literal files: nesting, aliases, comments, unclosed environments, plain TeX."""

from runweave.operators import tex

NESTED = r"""\documentclass{book}
\newtheorem{satz}[thm]{Theorem}
\newtheorem*{hilfs}{Auxiliary thing}
\declaretheorem[style=x, name={Key Lemma}]{key}
\newenvironment{myproblem}{a}{b}
\section{Über Mengen}
\begin{satz}[Main \emph{one}] \label{thm:main} \uses{a, b,a} \lean{My.main}
 Let $x$ % a comment
 be odd.
 \begin{remark} inner \end{remark}
\end{satz}
% between
 % and again
\begin{proof}[Idea] First. \begin{lemma} in a proof \end{lemma} \end{proof}
\begin{Lemma}\label{l:one}A\begin{lemma}B\end{lemma}C\end{lemma}
text \proof not adjacent \endproof
\subsection*{ Two }
\begin{theorem} never closed
\begin{key} K \end{key}  \proof short \endproof
\end{hilfs}
\begin{hilfs}H\end{hilfs}\begin{figure}x\end{figure}
\begin{myproblem}P\end{myproblem}
% \begin{claim} in a comment \end{claim}
"""
PLAIN = r"""\centerline{\titlefont A title}
\profess{Theorem 1.} Statement
of it. \label{one} \endprofess
\proof By hand. \endproof
\profess{Remark}R\endprofess
Text. \proof too late \endproof
"""


def test_blocks(spark):
    files = spark.createDataFrame([("a.tex", NESTED), ("b.tex", PLAIN), ("c.tex", None), ("d.tex", "")], "path string, text string")
    rows = {(r["path"], r["label"]): r for r in tex.tex_blocks(files).collect()}
    main = rows["a.tex", "thm:main"]
    assert main.asDict() == {
        "path": "a.tex", "kind": "theorem", "environment": "satz", "label": "thm:main", "title": r"Main \emph{one}", "uses": ["a", "b"], "lean": ["My.main"],
        "statement": r"Let $x$ be odd. \begin{remark} inner \end{remark}", "line": 7, "end_line": 11, "proof": r"First. \begin{lemma} in a proof \end{lemma}", "proof_line": 11, "proof_end_line": 14,
    }
    lemma = rows["a.tex", "l:one"]
    assert (lemma["kind"], lemma["environment"], lemma["statement"], lemma["proof"], lemma["line"]) == ("lemma", "Lemma", r"A\begin{lemma}B\end{lemma}C", "", 15)
    rest = {(p, label): (r["kind"], r["title"], r["statement"], r["proof"], r["end_line"], r["proof_end_line"]) for (p, label), r in rows.items() if label not in ("thm:main", "l:one")}
    assert rest == {
        ("a.tex", "line-14"): ("lemma", "", "in a proof", "", 14, 0), ("a.tex", "line-19"): ("lemma", "", "K", "short", 19, 19), ("a.tex", "line-21"): ("auxiliary", "", "H", "", 21, 0),
        ("a.tex", "line-22"): ("myproblem", "", "P", "", 22, 0), ("a.tex", "line-23"): ("claim", "", "in a comment", "", 23, 0),
        ("b.tex", "one"): ("theorem", "Theorem 1.", "Statement of it.", "By hand.", 3, 4), ("b.tex", "line-5"): ("remark", "Remark", "R", "", 5, 0),
    }


def test_sections(spark):
    files = spark.createDataFrame([("a.tex", NESTED), ("c.tex", None)], "path string, text string")
    assert [tuple(r) for r in tex.tex_sections(files).orderBy("nth").collect()] == [("a.tex", 1, "section", "Über Mengen", 6), ("a.tex", 2, "subsection", "Two", 17)]


def test_nothing(spark):
    assert tex.tex_blocks(spark.createDataFrame([], "path string, text string")).count() == 0
