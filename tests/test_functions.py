from pyspark.sql import functions as F

import pytest

from tessera import schema
from tessera.functions import text as fx
from tessera.functions.tokens import checked_budget, count_pieces


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_words_and_tokens(spark):
    w, t, m = one(spark, fx.words(F.lit("loadUserProfile load_2 Ärger")), fx.index_tokens(F.lit("PaymentService.café_x")), fx.strip_marks(F.lit("Ñandú ž")))
    assert w == ["load", "user", "profile", "2", "ärger"]
    assert t == ["paymentservice", "cafe", "x"]
    assert m == "Nandu z"
    assert fx.query_phrases('Pay  user.id "x" --') == [["pay"], ["user", "id"], ["x"]]


def test_names_and_paths(spark):
    got = one(
        spark, fx.occurrence_name(F.lit("npm pkg 1.0 src/`a.ts`/Pay#run().")), fx.last_segment(F.lit("A.b.c")), fx.compact(F.lit(" (a,\n  b) ")),
        fx.unquoted(F.lit("rb'''x'''")), fx.uri_path(F.lit("repo://r/a/b.ts")), fx.normalised(F.lit("a/./b/../../../c")), fx.dirname(F.lit("x.ts")), fx.dirname(F.lit("a/b/x.ts")),
        fx.numbered_lines(F.lit("p\nq")),
    )
    assert got == ["run", "c", "(a, b)", "x", "a/b.ts", "../c", ".", "a/b", ["1\tp", "2\tq"]]


def test_bonus_cosine_preview(spark):
    b, none, c, z, p = one(
        spark, fx.coverage_bonus(F.lit("Red Widget"), ["red", "wid", "gone", "x"]), fx.coverage_bonus(F.lit("red"), ["red"]),
        fx.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))), fx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), fx.preview(F.lit("x" * 301)),
    )
    assert b == pytest.approx((2 / 3) ** 2 * 0.03) and none == 0 and c == pytest.approx(0.5**0.5) and z == 0
    assert p == "x" * 300 + "… [preview]"


def test_identity(spark):
    def sid(path, sig):
        return schema.symbol_id(F.lit("r"), F.lit(path), F.lit("method"), F.lit("A.b"), F.lit(sig).cast("string"))

    a, b, c, d, r, u, p = one(spark, sid("./a.ts", "()"), sid("a.ts", "()"), sid("a.ts", None), sid("a.ts", ""), schema.repository_id(F.lit("r")), schema.file_uri(F.lit("r"), F.lit("./src/a.ts")), schema.point_id(sid("a.ts", "()")))
    assert a == b != c == d
    assert a.startswith("sym_") and len(a) == 36 and len(r) == 21 and u == "repo://r/src/a.ts"
    assert p.replace("-", "") == a[4:] and [len(x) for x in p.split("-")] == [8, 4, 4, 4, 12]


def test_budget():
    assert checked_budget(256) == 256 and count_pieces("abcdefgh (x)") == 5
    for bad in (255, 64001, 300.0, True):
        with pytest.raises(ValueError):
            checked_budget(bad)
