"""Queries of templates and documents, one document for each page of all sprites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.operators import exporters, grouping
from quiltwork.plans.assembly import _FRAMED, _SHEET, _framed, _pages
from quiltwork.plans.catalogue import query

_S = f"{_FRAMED}, {_SHEET.format('f')}"
_N = "chr(10)"
_NUMBER = lambda x: f"regexp_replace(regexp_replace(printf('%.1f', {x}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_OFFSET = f"{_NUMBER('l + w / 2 - rw / 2')} || ',' || {_NUMBER('t + h / 2 - rh / 2')}"
_CLASS = "regexp_replace(id, '[^A-Za-z0-9]', '_', 'g')"


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    framed = exporters.in_full(_framed(spark, d), F.when(F.col("ord") % 7 == 0, F.concat(F.lit("of_"), F.col("id"))))
    return exporters.contexts(framed, _pages(_framed(spark, d)), ["page"])


def _made(template: str, change=lambda c: c):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return exporters.exported(_contexts(spark, d), template, change=change).select("page", "document")

    return run


def _documents(name: str, template: str, row: str, between: str = "''", before: str = "''", after: str = "''", change=lambda c: c, says: str = "") -> None:
    """Registers a template with the SQL that puts its rows together."""
    run = _made(template, change)
    run.__name__, run.__doc__ = name, says
    query(f"WITH {_S}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY page) AS many FROM s) SELECT page, {before} || string_agg({row}, {between} ORDER BY id) || {after} AS document FROM n GROUP BY page")(run)


_IMAGE = "'page' || page || '.png'"
_documents("template_values", "{{meta.image}} {{meta.size.w}}x{{{meta.size.h}}} {{frames.length}} {{frames.0.filename}}{{none.of.these}} {{frames.0.trimmed}} {{meta.size}}\n", "''", before=f"{_IMAGE} || ' ' || max(pw) || 'x' || max(ph) || ' ' || count(*) || ' ' || min(id) || ' ' || CAST(arg_min(trimmed, id) AS VARCHAR) || ' [object]' || {_N}", says="Values, lengths, elements by number, and names of nothing.")
_documents("template_each", "{{#each frames}}{{this.filename}} {{frame.x}},{{this.frame.y}};{{else}}empty{{/each}}{{#each animations}}{{name}}{{else}} still{{/each}}", f"id || ' ' || fx || ',' || fy || ';'", after="' still'", says="Rows of an array, and what stands for an empty one.")
_documents("template_if_else", "{{#each frames}}{{#if rotated}}R{{else if trimmed}}T{{else}}-{{/if}}{{#if spriteSourceSize.x}}x{{/if}}{{#if spriteSourceSize.x includeZero=true}}0{{/if}}{{/each}}", "CASE WHEN rotated THEN 'R' WHEN trimmed THEN 'T' ELSE '-' END || CASE WHEN l <> 0 THEN 'x' ELSE '' END || '0'", says="Conditions on booleans and numbers, one after the other.")
_documents("template_unless_last", "[{{#each frames}}{{filename}}{{#unless @last}},{{/unless}}{{/each}}]", "id", "','", "'['", "']'", says="Commas between, by the last place.")
_documents("template_index", "{{#each frames as |sprite place|}}{{#if @first}}first {{/if}}{{@index}}/{{place}} {{sprite.filename}}\n{{/each}}", f"CASE WHEN i = 0 THEN 'first ' ELSE '' END || i || '/' || i || ' ' || id || {_N}", says="Places, and names given to item and place.")
_documents("template_parent_and_root", "{{#each sheets}}{{#each frames}}{{../file}} {{@root.meta.format}} {{@../index}} {{#with frame}}{{../filename}} {{w}}{{/with}};{{/each}}{{/each}}", f"{_IMAGE} || ' RGBA8888 0 ' || id || ' ' || w || ';'", says="Names and places of the blocks around.")
_documents("template_lines", "{{!-- a comment, and blocks on lines of their own --}}\n{{#each frames}}\n  {{filename}}\n  {{#if rotated}}\n  turned\n  {{/if}}\n{{/each}}\n<{{~ meta.scale ~}} >\n", f"'  ' || id || {_N} || CASE WHEN rotated THEN '  turned' || {_N} ELSE '' END", after=f"'<1>' || {_N}", says="Lines of tags alone leave no line; blanks next to ~ go.")
_documents("template_calls", "{{#each frames}}{{#if (and rotated (gt frame.w 20))}}{{filename}}{{/if}}{{#unless (eq page 0)}}+{{/unless}}{{/each}}", "CASE WHEN rotated AND w > 20 THEN id ELSE '' END || CASE WHEN page = 0 THEN '' ELSE '+' END", says="Comparisons within conditions.")
_documents("template_properties", exporters.FAMILIES["plain"], f"""id || ': frame=(' || fx || ',' || fy || ',' || w || ',' || h || ') rotated=' || CAST(rotated AS VARCHAR) || ' page=' || page || ' pivot=(0.5,' || CAST(CAST(py AS DOUBLE) AS VARCHAR) || ') offset=(' || l || ',' || t || ') size=(' || rw || ',' || rh || ')' || CASE WHEN CAST(right(id, 9) AS BIGINT) % 7 = 0 THEN ' alias-of=of_' || id ELSE '' END || {_N}""", after=f"'string_property: told' || {_N} || 'bool_property: false' || {_N}", change=lambda c: exporters.with_properties(c, "told", False), says="The plain family in full, with an exporter's properties.")
_documents("export_tsv", exporters.FAMILIES["tsv"], f"concat_ws(chr(9), id, fx, fy, w, h, l, t, rw, rh, CAST(rotated AS INT), page, 0.5, CAST(py AS DOUBLE)) || {_N}", before="'" + "' || chr(9) || '".join(n for n, _ in exporters.COLUMNS) + f"' || {_N}", says="The table family in full.")
_documents("export_css", exporters.FAMILIES["css"], f"""'.icon-' || {_CLASS} || ' {{' || {_N} || '  width: ' || CASE WHEN rotated THEN h ELSE w END || 'px;' || {_N} || '  height: ' || CASE WHEN rotated THEN w ELSE h END || 'px;' || {_N} || '  background-image: url(' || {_IMAGE} || ');' || {_N} || '  background-position: -' || fx || 'px -' || fy || 'px;' || {_N} || '}}' || {_N}""", before=f"'/* ' || page || ': ' || {_IMAGE} || ' */' || {_N}", change=lambda c: exporters.with_class_prefix(c, "icon-"), says="Style sheets with a class prefix.")
_PLIST = {"frame": "fx || ',' || fy || ',' || w || ',' || h", "offset": _OFFSET, "rotated": None, "sourceSize": "rw || ',' || rh", "trimmed": None, "pivot": "'0.5,' || CAST(CAST(py AS DOUBLE) AS VARCHAR)", "page": None}
_FLAG = lambda c: f"CASE WHEN {c} THEN '<true/>' ELSE '<false/>' END"
_T = lambda n: "repeat(chr(9), %d)" % n
_ENTRY = lambda k, v, n: f"{_T(n)} || '<key>{k}</key>' || {_N} || {_T(n)} || {v} || {_N}"
_STRING = lambda v: f"'<string>' || {v} || '</string>'"
_PLIST_ROW = f"{_T(2)} || '<key>' || id || '</key>' || {_N} || {_T(2)} || '<dict>' || {_N} || " + " || ".join(_ENTRY(k, _STRING(v) if v else "'<integer>' || page || '</integer>'" if k == "page" else _FLAG(k), 3) for k, v in _PLIST.items()) + f" || CASE WHEN CAST(right(id, 9) AS BIGINT) % 7 = 0 THEN {_ENTRY('alias', _STRING(chr(39) + 'of_' + chr(39) + ' || id'), 3)} ELSE '' END || {_T(2)} || '</dict>' || {_N}"
_PLIST_HEAD = exporters.FAMILIES["plist"].split("{{#each frames}}")[0].replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
_documents("export_plist", exporters.FAMILIES["plist"], _PLIST_ROW, before=f"'{_PLIST_HEAD}'", after=f"{_T(1)} || '</dict>' || {_N} || {_T(1)} || '<key>metadata</key>' || {_N} || {_T(1)} || '<dict>' || {_N} || {_ENTRY('format', chr(39) + '<integer>3</integer>' + chr(39), 2)} || {_ENTRY('realTextureFileName', _STRING(_IMAGE), 2)} || {_ENTRY('size', _STRING('max(pw) || chr(44) || max(ph)'), 2)} || {_ENTRY('textureFileName', _STRING(_IMAGE), 2)} || {_T(1)} || '</dict>' || {_N} || '</dict>' || {_N} || '</plist>' || {_N}", says="Property lists in full.")
_HEADER = exporters.FAMILIES["header"].split("{{#each frames}}")[0].replace("\n", "' || chr(10) || '")
_documents("export_header", exporters.FAMILIES["header"], f"""'    {{ "' || id || '", ' || fx || ', ' || fy || ', ' || w || ', ' || h || ', ' || l || 'f, ' || t || 'f, ' || rw || 'f, ' || rh || 'f, ' || CAST(rotated AS VARCHAR) || ', ' || page || ', 0.5f, ' || CAST(CAST(py AS DOUBLE) AS VARCHAR) || 'f }},' || {_N}""", before=f"'{_HEADER}'", after=f"'}};' || {_N} || {_N} || 'static constexpr int kSpriteCount = ' || count(*) || ';' || {_N} || '}} // namespace atlas' || {_N}", says="Headers in full.")


@query(f"WITH {_S} SELECT page, '@media (min-resolution: 2dppx) {{' || {_N} || string_agg('.' || {_CLASS} || '{{}}', '' ORDER BY id) || '}}' || {_N} AS document, string_agg('.' || {_CLASS} || '{{}}', '' ORDER BY id) AS plain FROM s GROUP BY page")
def media_queries(spark: SparkSession, d: str) -> DataFrame:
    made = exporters.exported(_contexts(spark, d), "{{#each frames}}.{{cssClass}}{}{{/each}}")
    return made.select("page", exporters.in_media_query(F.col("document"), " (min-resolution: 2dppx) ", 2.0).alias("document"), exporters.in_media_query(F.col("document"), "x", 1.0).alias("plain"))


_J = lambda depth, *rows: f"'{'  ' * depth}' || " + f" || ',' || {_N} || '{'  ' * depth}' || ".join(rows)
_O = lambda name, depth, *rows: f"""'"{name}": {{' || {_N} || {_J(depth + 1, *rows)} || {_N} || '{'  ' * depth}}}'"""
_V = lambda name, value: f"""'"{name}": ' || {value}"""
_FRAME = _J(3, _V("filename", "'\"' || id || '\"'"), _O("frame", 3, _V("x", "fx"), _V("y", "fy"), _V("w", "w"), _V("h", "h")), _V("rotated", "CAST(rotated AS VARCHAR)"), _V("trimmed", "CAST(trimmed AS VARCHAR)"), _O("spriteSourceSize", 3, _V("x", "l"), _V("y", "t"), _V("w", "w"), _V("h", "h")), _O("sourceSize", 3, _V("w", "rw"), _V("h", "rh")), _O("pivot", 3, _V("x", "'0.5'"), _V("y", "CAST(CAST(py AS DOUBLE) AS VARCHAR)")), _V("page", "page"), _V("aliased", "CAST(CAST(right(id, 9) AS BIGINT) % 7 = 0 AS VARCHAR)"), _V("aliasTarget", "CASE WHEN CAST(right(id, 9) AS BIGINT) % 7 = 0 THEN '\"of_' || id || '\"' ELSE 'null' END"), _V("border", "'null'"), _V("hasNormalMap", "'false'"))
_META = _O("meta", 1, _V("app", "'\"quiltwork\"'"), _V("version", "'\"1\"'"), _V("image", f"'\"' || {_IMAGE} || '\"'"), _V("format", "'\"RGBA8888\"'"), _O("size", 2, _V("w", "max(pw)"), _V("h", "max(ph)")), _V("scale", "'\"1\"'"), f"""'"pages": [' || {_N} || '      {{' || {_N} || {_J(4, _V("index", "page"), _V("file", f"'\"' || {_IMAGE} || '\"'"), _V("width", "max(pw)"), _V("height", "max(ph)"))} || {_N} || '      }}' || {_N} || '    ]'""")


@query(f"""WITH {_S} SELECT page, '{{' || {_N} || {_J(1, "'\"animations\": []'", "'\"filter\": \"Linear, Linear\"'", _META, f"'\"frames\": [' || {_N} || string_agg('    {{' || {_N} || {_FRAME} || {_N} || '    }}', ',' || {_N} ORDER BY id) || {_N} || '  ]'")} || {_N} || '}}' AS document FROM s GROUP BY page""")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON array family as it is written: without sheets and the seven inner fields, over several lines."""
    return exporters.json_documents(_contexts(spark, d)).select("page", "document")


@query("""WITH turns AS (SELECT conv_id, role || '_' || lpad(CAST(turn AS VARCHAR), 3, '0') AS id FROM conversations), a AS (SELECT conv_id, regexp_extract(id, '^(.*_)([0-9]+)$', 1) AS base, list(id ORDER BY id) AS ids FROM turns GROUP BY ALL HAVING count(*) >= 2)
    SELECT conv_id, string_agg('  <key>' || regexp_replace(base, '_$', '') || '</key>' || array_to_string(list_transform(ids, lambda x: '<string>' || x || '</string>'), ''), chr(10) ORDER BY base) AS document FROM a GROUP BY conv_id""")
def template_animations(spark: SparkSession, d: str) -> DataFrame:
    """Animations of each conversation's turns, through a template."""
    from quiltwork.functions.text import frame_suffix
    from quiltwork.plans.views import table

    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit("_"), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("id"))
    found = grouping.animations(turns, *frame_suffix(F.col("id")), "id", "turn", key=["conv_id"])
    context = found.groupBy("conv_id").agg(F.struct(F.sort_array(F.collect_list(F.struct("name", "frames"))).alias("animations")).alias("context"))
    return exporters.exported(context, "{{#each animations}}  <key>{{name}}</key>{{#each frames}}<string>{{this}}</string>{{/each}}{{#unless @last}}\n{{/unless}}{{/each}}").select("conv_id", "document")
