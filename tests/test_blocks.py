"""Blocks to take out, of a literal proof."""

from runweave.operators import blocks

PROOF = """theorem t : P := by
  have small : A := by simp
  have big : B := by
    intro x -- have hidden : C := by
    have inner : D := by
      exact 1

    /- sorry
  have gone : E := by -/
    exact "admit"

  have hole : F := by
    sorry
  have term : G :=
    foo
  rfl
    have deep : H := by
      a
      b
  have last : I := by
\t\ta
   b
"""


def test_blank():
    assert blocks.blank('a /- b /- c -/ d\n-/ e -- f\n"g\\"h" i') == "a " + " " * 14 + "\n" + "   e " + "    \n" + " " * 6 + " i"
    assert blocks.blank(None) == "" and blocks.blank("-/ x") == "-/ x"


def test_candidates(spark):
    found = spark.createDataFrame([(1, PROOF), (2, None), (3, "theorem x : P := rfl"), (4, "theorem y : P := by\n    have a : A := by\n      b")], "id int, text string")
    got = sorted(tuple(r) for r in blocks.extraction_candidates(found, least=2).collect())
    big = PROOF[PROOF.index("  have big") : PROOF.index('"admit"') + 7]
    last = PROOF[PROOF.index("  have last") :].rstrip()
    assert got == [(1, 1, "big", 3, 8, len(big)), (1, 2, "last", 20, 3, len(last)), (4, 1, "a", 2, 2, 28)]
    assert [r["name"] for r in blocks.extraction_candidates(found, least=4).collect()] == ["big"]
