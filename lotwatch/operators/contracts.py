"""JSON contracts compiled to Spark: a type to read by, and named checks of whole documents.

A contract is a JSON Schema as a dictionary: type (with null), properties,
required, additionalProperties, items, enum, const, pattern, minimum, maximum,
maxLength, minItems, format (date, date-time, uri) and $ref to $defs.  Documents are
checked as VARIANT, natively, so that unknown keys and wrong types are seen
that a declared type would drop or null.  A check is named by its place and
keyword, as in `listings[].price.currency:pattern`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
FORMATS = {"date": "date", "date-time": "timestamp"}
# What texts of a format look like; whether a day exists is asked of the type.
LOOKS = {"date": r"^\d{4}-\d{2}-\d{2}$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*$"}
#: What schema_of_variant says of values of a type.
VARIANTS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$"}


def kinds(node: dict) -> list[str]:
    kind = node.get("type", [])
    return [kind] if isinstance(kind, str) else kind


def resolved(node: dict, root: dict) -> dict:
    """node, or what its $ref names."""
    while "$ref" in node:
        at = root
        for part in node["$ref"].removeprefix("#/").split("/"):
            at = at[part]
        node = at
    return node


def spark_type(node: dict, root: dict | None = None) -> str:
    """The type that documents of a contract are read by; objects without named properties are maps, days are dates."""
    root = root or node
    node = resolved(node, root)
    kind = next((k for k in kinds(node) if k != "null"), "string" if isinstance(node.get("const", ""), str) else "double")
    if kind == "array":
        return f"array<{spark_type(node.get('items', {}), root)}>"
    if kind == "object":
        if node.get("properties"):
            return f"struct<{','.join(f'`{k}`:{spark_type(v, root)}' for k, v in node['properties'].items())}>"
        more = node.get("additionalProperties")
        return f"map<string,{spark_type(more, root) if isinstance(more, dict) else 'variant'}>"
    return FORMATS.get(node.get("format", ""), TYPES[kind])


def breaches(node: dict, value: Column, path: str, root: dict) -> Column:
    """Names of the checks of a contract that a VARIANT breaks, as an array; a missing value breaks none."""
    node = resolved(node, root)
    kept: dict[str, Column] = {}  # what holds (true or null) if a check is kept
    inner: list[Column] = []
    absent = value.isNull()
    nothing = absent | F.is_variant_null(value)
    text, number, said = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double"), F.schema_of_variant(value)
    is_ = lambda kind: said.rlike(VARIANTS[kind])
    if kinds(node):
        fits = absent
        for k in kinds(node):
            # 3.0 is an integer to a contract.
            fits = fits | (is_("number") & (number == F.floor(number)) if k == "integer" else is_(k))
        kept["type"] = fits
    if "enum" in node:
        kept["enum"] = nothing | text.isin(node["enum"])
    if "const" in node:
        kept["const"] = absent | (text == F.lit(str(node["const"])))
    if "pattern" in node:
        kept["pattern"] = nothing | ~is_("string") | text.rlike(node["pattern"])
    if "maxLength" in node:
        kept["maxLength"] = nothing | ~is_("string") | (F.length(text) <= node["maxLength"])
    if "format" in node:
        form = node["format"]
        real = F.try_to_date(text).isNotNull() if form == "date" else F.try_to_timestamp(text).isNotNull() if form == "date-time" else F.lit(True)
        kept["format"] = nothing | ~is_("string") | (text.rlike(LOOKS[form]) & real)
    if "minimum" in node:
        kept["minimum"] = nothing | ~is_("number") | (number >= node["minimum"])
    if "maximum" in node:
        kept["maximum"] = nothing | ~is_("number") | (number <= node["maximum"])
    join = lambda key: f"{path}.{key}" if path else key
    at = lambda key: F.try_variant_get(value, f"$['{key}']", "variant")
    named, more = node.get("properties", {}), node.get("additionalProperties")
    entries = F.when(is_("object"), F.try_variant_get(value, "$", "map<string,variant>"))
    if more is False:
        kept["unknown"] = absent | entries.isNull() | (F.size(F.array_except(F.map_keys(entries), F.array(*map(F.lit, named)))) == 0)
    required = [F.when(is_("object") & at(key).isNull(), f"{join(key)}:required") for key in node.get("required", [])]
    inner += [breaches(v, at(key), join(key), root) for key, v in named.items()]
    if isinstance(more, dict):
        inner.append(of_all(more, F.map_values(F.map_filter(entries, lambda k, v: ~k.isin(list(named))) if named else entries), f"{path}.*", root))
    values = F.when(is_("array"), F.try_variant_get(value, "$", "array<variant>"))
    if "minItems" in node:
        kept["minItems"] = values.isNull() | (F.size(values) >= node["minItems"])
    if "items" in node:
        inner.append(of_all(node["items"], values, f"{path}[]", root))
    told = [F.when(~F.coalesce(ok, F.lit(True)), f"{path}:{name}") for name, ok in kept.items()] + required
    return F.concat(F.array_compact(F.array(*told)) if told else none_broken(), *inner)


def none_broken() -> Column:
    return F.array().cast("array<string>")


def of_all(node: dict, values: Column, path: str, root: dict) -> Column:
    """Names of the checks that any of the values breaks."""
    found = F.array_distinct(F.flatten(F.transform(values, lambda v: breaches(node, v, path, root))))
    return F.coalesce(found, none_broken())


def broken(contract: dict, document: Column) -> Column:
    """Names of the checks that a document (VARIANT) breaks; of one that is null, `document`."""
    return F.when(document.isNull(), F.array(F.lit("document"))).otherwise(breaches(contract, document, "", contract))


def judged(df: DataFrame, contract: dict, text: str, out: str = "violations") -> DataFrame:
    """df with the names of the checks that its JSON text breaks; text that is no JSON breaks `document`."""
    return df.withColumn("_document", F.try_parse_json(text)).withColumn(out, broken(contract, F.col("_document"))).drop("_document")


def require_documents(df: DataFrame, contract: dict, what: str) -> DataFrame:
    """df, failing where a row breaks the contract in the fields that it names; its other columns aren't looked at."""
    named = [c for c in df.columns if c in contract["properties"]]
    wrong = broken(contract, F.parse_json(F.to_json(F.struct(*named), {"ignoreNullFields": "false"})))
    say = F.concat(F.lit(f"{what} breaks "), F.array_join(wrong, ", "))
    return df.filter(F.when(F.size(wrong) > 0, F.raise_error(say).cast("boolean")).otherwise(True))
