import pytest

from factorloom.plans.libraries import COMPACT_20, wide_158
from factorloom.plans.parser import ExpressionError, canonical, common_subtree, parse


@pytest.mark.parametrize("text", ["$a +", "($a", "$a)", "$a ^ 2", "F($a", "$a $b", ""])
def test_malformed_text_is_rejected(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_precedence():
    assert canonical(parse("1 + 2 * 3 > 4 && $x || $y ? $a : $b")) == canonical(parse("((((1 + (2 * 3)) > 4) && $x) || $y) ? $a : $b"))


def test_commutative_trees_are_equal_and_others_not():
    assert canonical(parse("$a * ($b + 1)")) == canonical(parse("(1 + $b) * $a"))
    assert canonical(parse("$a - $b")) != canonical(parse("$b - $a"))


def test_common_subtree():
    assert common_subtree(parse("RANK(TS_MEAN($close, 5)) + 1"), parse("ABS(TS_MEAN($close, 5))"))[0] == 3


def test_libraries_parse():
    assert len(COMPACT_20) == 20 and len(wide_158()) == 158
    for text in (*COMPACT_20.values(), *wide_158().values()):
        parse(text)
