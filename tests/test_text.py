"""Text functions: the Column form against the Python twin and known values."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


SAMPLES = ["Éàﬁß x", "  Hello,  World! ", "a.b", "日本語", "", "Ångström 12½", "tab\there\nline", "Ǆ ĳ ﬃ", "ＦＵＬＬ width", "x̂y", "𝐛𝐨𝐥𝐝 42"]


@pytest.mark.parametrize("s", SAMPLES)
def test_twins_agree(spark, s):
    c = F.lit(s)
    assert value(spark, X.sanitize_label(c)) == X.py_sanitize_label(s)
    if "½" not in s:  # a sign that stands for several characters, not all letters
        assert value(spark, X.normalize_label(c)) == X.py_normalize_label(s)
        assert value(spark, X.slugify(c)) == X.py_slugify(s)


def test_labels(spark):
    assert value(spark, X.normalize_label(F.lit("Éàﬁß"))) == "eafi"
    assert value(spark, X.slugify(F.lit("日本"))) == "section"  # labels without ASCII letters share one slug
    assert value(spark, X.sanitize_label(F.lit("a\nb\x00c  "))) == "abc"  # controls go, they leave no space
    assert len(value(spark, X.sanitize_label(F.lit("x" * 300)))) == 256
    assert value(spark, X.sanitize_label(F.lit(None).cast("string"))) == ""
    assert X.py_sanitize_text("a\ud800b") == "ab"
    assert X.py_sanitize_value({"a": ["x\udc00", 1]}) == {"a": ["x", 1]}


def test_paths(spark):
    f = F.lit
    assert value(spark, X.extension_of(f("a\\b.TS"))) == ".ts" and value(spark, X.extension_of(f("a.b/c"))) == ""
    assert value(spark, X.without_extension(f("docs/guide.md"))) == "docs/guideguide"
    assert value(spark, X.without_extension(f("docs/guide.md"), fix=True)) == "docs/guide"
    assert value(spark, X.without_extension(f("docs/guide"))) == "docs/guide"
    assert value(spark, X.basename(f("a/b//"))) == "b" and value(spark, X.basename(f("/"))) is None
    cases = [("src/a/b.ts", "./c", "src/a/c"), ("src/a/b.ts", "../../x/y", "x/y"), ("b.ts", "../../up", "up"), ("src/b.ts", "@/lib/z", "src/lib/z"), ("src/b.ts", "react", "react"), (None, "./c", "c")]
    for base, target, want in cases:
        assert value(spark, X.resolve_relative_path(f(base).cast("string"), f(target))) == want == X.py_resolve_relative_path(base, target)


def test_small_ones(spark):
    assert value(spark, X.location_label(F.lit(3))) == "L3" and value(spark, X.location_label(F.lit(0))) is None
    assert value(spark, X.inline_tags(F.lit("#a b #c-d x#no\n#é_1"))) == ["a", "c-d", "é_1"]
    assert value(spark, X.edge_weight(F.lit(None).cast("double"))) == 2.0 and value(spark, X.edge_weight(F.lit(0.0))) == 100.0
    assert value(spark, X.normalize_alias(F.lit("Docs\\My Guide.md"))) == "docs-my-guide-md"
