"""Templates as expressions, folders of exporters, and JSON over several lines."""

import json

import pytest
from pyspark.sql import functions as F

from quiltwork.functions.templates import TemplateError, rendered
from quiltwork.operators import exporters, frames

CONTEXT = """named_struct('name','n','n',3,'zero',0,'yes',true,'no',false,'none',cast(null as string),'d',0.5D,'tags',array('a','b'),'empty',array(),
 'rows',array(named_struct('id','x','v',array(1,2)),named_struct('id','y','v',array(3))),'meta',named_struct('w',1,'h',2),'m',map('k1',1),'nan',double('nan'),'odd name','o')"""
CASES = [
    ("a {{name}} {{n}} {{meta.w}} {{nope}} {{nope.x}}{{none}} {{yes}} {{d}} {{tags}} {{meta}}", "a n 3 1   true 0.5 [a, b] [object]"),
    ("{{#each rows}}{{@index}}{{id}}{{#each v}}<{{this}}{{../id}}{{@../index}}{{@root.name}}>{{/each}}{{#unless @last}},{{/unless}}{{/each}}", "0x<1x0n><2x0n>,1y<3y1n>"),
    ("{{#if zero}}1{{else if yes}}2{{else}}3{{/if}}{{#if zero includeZero=true}}z{{/if}}{{#if nan}}x{{/if}}{{#if tags}}t{{/if}}{{#if empty}}e{{/if}}{{#if meta}}s{{/if}}{{#if none}}x{{/if}}", "2zts"),
    ("{{#each empty}}x{{else}}none{{/each}}{{#each nope}}x{{else}}no{{/each}}{{#each name}}x{{else}}text{{/each}}", "nonenotext"),
    ("a\n{{#if yes}}\n  b\n{{else}}\n  c\n{{/if}}\nd\n", "a\n  b\nd\n"),
    ("  {{! alone }}  \r\nx{{! not }} \ny", "x \ny"),
    ("a {{~#if yes~}} b {{~/if~}} c", "abc"),
    ("{{! hi }}{{!-- {{x}} --}}x\\{{y}}", "x{{y}}"),
    ("{{#with meta}}{{w}}x{{h}}{{../name}}{{/with}}{{#with none}}{{else}}-{{/with}}", "1x2n-"),
    ("{{#each meta}}{{@key}}={{this}}{{#unless @last}};{{/unless}}{{/each}} {{#each m}}{{@key}}{{this}}{{/each}}", "w=1;h=2 k11"),
    ("{{#each rows as |r i|}}{{i}}{{r.id}}{{r.v.length}}{{r.v.[0]}}{{/each}} {{rows.1.id}} {{tags.length}} {{[odd name]}}{{this.name}}", "0x211y13 y 2 on"),
    ("{{#if (eq n 3)}}t{{/if}}{{#if (and yes (gt n 5))}}t{{else}}f{{/if}}{{#if (not none)}}n{{/if}}{{{name}}}{{&name}}{{#if (or no (ne name 'n'))}}x{{/if}}{{#if (lt n 3.5)}}l{{/if}}", "tfnnnl"),
    ("{{../name}}{{@index}}{{name.length}}{{tags.9}}<{{'text'}}>", "<text>"),
    ("<b>&{{name}}</b>", "<b>&n</b>"),
    ("", ""),
]


@pytest.mark.parametrize("template,text", CASES)
def test_features(spark, template, text):
    df = spark.sql(f"select {CONTEXT} as c union all select {CONTEXT}")
    assert [r[0] for r in df.select(rendered(template, F.col("c"), df.schema["c"].dataType)).collect()] == [text, text]


ERRORS = [
    ("{{#each a}}", "each isn't closed"), ("x\n{{/if}}", "line 2"), ("{{#foo}}{{/foo}}", "no block foo"), ("{{#if a}}{{/each}}", "closes if"), ("{{else}}", "without a block"), ("{{}}", "empty tag"),
    ("{{#if}}{{/if}}", "without a value"), ("{{> part}}", "partials"), ("{{#if (foo a)}}{{/if}}", "no call"), ("{{#if a}}{{else foo}}{{/if}}", "no block foo"),
]


@pytest.mark.parametrize("template,says", ERRORS)
def test_errors_come_before_any_row(spark, template, says):
    df = spark.sql(f"select {CONTEXT} as c")
    with pytest.raises(TemplateError, match=says):
        rendered(template, F.col("c"), df.schema["c"].dataType)


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(F.expr(CONTEXT).alias("c"))
    plan = df.select(rendered(CASES[1][0], F.col("c"), df.schema["c"].dataType))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_folder_of_exporters(spark, tmp_path):
    (tmp_path / "mine.hbs").write_text("{{name}}ü\n")
    (tmp_path / "also.hbs").write_text("-")
    (tmp_path / ".hbs").write_text("x")
    (tmp_path / "other.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.hbs").write_text("x")
    assert exporters.custom_exporters(spark, str(tmp_path)) == {"also": "-", "mine": "{{name}}ü\n"}
    assert exporters.custom_exporters(spark, str(tmp_path / "none")) == {}


@pytest.fixture
def contexts(spark):
    placed = spark.createDataFrame(
        [("b/1", 0, 10, 20, True, 30, 41, 4, 5, 40, 50, 0.5, 1.0), ("a", 0, 0, 0, False, 8, 8, 0, 0, 8, 8, 0.5, 0.5), ('q"', 1, 1, 2, False, 3, 4, 0, 0, 3, 4, 0.25, 0.5)],
        "id string, page int, x int, y int, rotated boolean, w int, h int, left int, top int, raw_w int, raw_h int, pivot_x double, pivot_y double",
    )
    framed = exporters.in_full(frames.described(placed), F.when(F.col("id") == "a", "b/1"))
    pages = spark.createDataFrame([(0, "p0.png", 64, 64), (1, "p1.png", 8, 8)], "page int, file string, width int, height int")
    return exporters.contexts(framed, pages, [], scale="0.5", nearest=True)


def test_context(contexts):
    (row,) = contexts.collect()
    c = row.context
    assert [f.filename for f in c.frames] == ["a", "b/1", 'q"'] and [len(s.frames) for s in c.sheets] == [2, 1] and [s["index"] for s in c.sheets] == [0, 1]
    b = c.frames[1]
    assert (b.offset, b.frameX, b.frameY, b.frameWidth, tuple(b.offsetBottomLeft), b.cssClass) == ("-1,0.5", -4, -5, 40, (4, 4), "b_1") and c.frames[0].aliased and c.frames[0].aliasTarget == "b/1" and not b.aliased
    assert c.meta.image == "p0.png" and c.meta.scale == "0.5" and [p.file for p in c.meta.pages] == ["p0.png", "p1.png"] and c.filter.startswith("Nearest")


def test_json(contexts):
    (row,) = exporters.json_documents(contexts).collect()
    said = json.loads(row.document)
    assert row.document == json.dumps(said, indent=2, ensure_ascii=False) and list(said) == ["animations", "filter", "meta", "frames"]
    assert not set(said["frames"][0]) & set(exporters.INNER) and said["frames"][2]["filename"] == 'q"' and said["frames"][0]["border"] is None


def test_properties_and_prefix(contexts):
    template = "{{exporterProperties.string_property}}|{{#if exporterProperties.has_string}}s{{/if}}{{#if exporterProperties.has_bool}}{{exporterProperties.bool_property}}{{/if}}{{#each sheets}}{{#each frames}} {{cssClass}}{{/each}}{{/each}}"
    one = lambda change: exporters.exported(contexts, template, change=change).first().document
    assert one(lambda c: c) == "| a b_1 q_" and one(lambda c: exporters.with_properties(c, flag=False)) == "|false a b_1 q_"
    assert one(lambda c: exporters.with_class_prefix(exporters.with_properties(c, "t"), "i-")) == "t|s i-a i-b_1 i-q_"


def test_pretty_values(spark):
    df = spark.sql("""select named_struct('a', array(), 'b', map('k"', array(1, null)), 'c', cast(null as struct<x:int>), 'd', 'line\\nü', 'e', null, 'f', true, 'g', map()) v""")
    text = df.select(exporters.pretty(F.col("v"), df.schema["v"].dataType)).first()[0]
    assert text == json.dumps({"a": [], "b": {'k"': [1, None]}, "c": None, "d": "line\nü", "e": None, "f": True, "g": {}}, indent=2, ensure_ascii=False)
