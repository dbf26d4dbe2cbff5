"""Definitions are found without visiting expressions, in the order of ast.walk."""

import ast

from quernstone.sources import code

SOURCE = """
class A:
    def f(self, x=[i for i in range(9)]):
        try:
            def g(): pass
        except ValueError:
            def h(): pass
        else:
            async def i(): pass
        finally:
            class B: pass
for x in y:
    with z:
        match x:
            case 1:
                def f(a): pass
while True:
    if a:
        pass
    else:
        def j(): pass
"""


def test_same_order_as_walk():
    tree = ast.parse(SOURCE)
    kinds = (ast.ClassDef, *code.FUNCTIONS)
    assert code._definitions(tree) == [n for n in ast.walk(tree) if isinstance(n, kinds)] and len(code._definitions(tree)) == 8


def test_expressions_are_not_visited():
    seen = []

    class List(list):
        def __iter__(self):
            seen.append(1)
            return super().__iter__()

    tree = ast.parse("def f():\n    x = [1]\n")
    tree.body[0].body[0].value.elts = List(tree.body[0].body[0].value.elts)
    assert [n.name for n in code._definitions(tree)] == ["f"] and not seen


def test_static_gate_uses_all_cores(spark):
    from quernstone.plans import registry

    plan = registry.queries()["static_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression")
