"""The operators as SQL functions, for queries that are written as SQL. They are inlined, so Catalyst plans them as it plans the DataFrame form."""

from __future__ import annotations

from pyspark.sql import SparkSession

from larkspur.operators.rules import Rule, RuleSet


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(value: str) -> str:
    return "`" + value.replace("`", "``") + "`"


def _test(rule: Rule) -> str:
    holds = lambda phrase: f"contains(lower(coalesce(asked, '')), {_text(phrase.lower())})"
    ways = [holds(p) for p in rule.any_of] + ["(" + " AND ".join(holds(p) for p in group) + ")" if group else "true" for group in rule.all_of]
    return " OR ".join(ways) or "false"


def create_router(spark: SparkSession, name: str, rules: RuleSet) -> None:
    """name(text): the label of the first rule that holds, as classify() gives it."""
    cases = " ".join(f"WHEN {_test(r)} THEN {_text(r.label)}" for r in rules.rules)
    body = f"CASE {cases} ELSE {_text(rules.default)} END" if cases else _text(rules.default)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_name(name)}(asked STRING) RETURNS STRING RETURN {body}")


def create_lookup(spark: SparkSession, name: str, primary: str, fallback: str, on: str) -> None:
    """name(key): a table function, used as LEFT JOIN LATERAL name(key): the row of the view primary, else that of the view fallback, with the column
    tier. Each view has one row a key at most, and both the same columns, but for tier. The tiers are joined to each other and then to the
    keys, which are neither made distinct nor joined to themselves, as they would be with the outer joins on the keys inside the function."""
    schema = spark.table(primary).schema
    names, key = [f.name for f in schema.fields if f.name != on], _name(on)
    result = ", ".join(f"{_name(f.name)} {f.dataType.simpleString()}" for f in schema.fields if f.name != on)
    one = ", ".join(f"CASE WHEN p.{key} IS NOT NULL THEN p.{_name(n)} ELSE f.{_name(n)} END AS {_name(n)}" for n in names)
    tiers = f"SELECT coalesce(p.{key}, f.{key}) AS found_key, {one}, CASE WHEN p.{key} IS NOT NULL THEN 'primary' ELSE 'fallback' END AS tier FROM {_name(primary)} p FULL JOIN {_name(fallback)} f ON p.{key} = f.{key}"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {_name(name)}(asked {schema[on].dataType.simpleString()}) RETURNS TABLE({result}, tier STRING) RETURN "
        f"SELECT {', '.join([*map(_name, names), 'tier'])} FROM ({tiers}) WHERE found_key = asked"
    )
