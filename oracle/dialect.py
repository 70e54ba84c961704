"""DuckDB spelling of the adapter constructors, and the adapters as SQL text."""

from __future__ import annotations

from sightline.sources.adapters import STAGES


class DuckDialect:
    @staticmethod
    def arr(*items: str) -> str:
        return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"

    @staticmethod
    def hdr(name: str, value: str) -> str:
        return f"{{'name': {name}, 'value': {value}}}"

    @staticmethod
    def par(loc: str, name: str, value: str) -> str:
        return f"{{'location': '{loc}', 'name': {name}, 'value': {value}}}"

    @staticmethod
    def b64url(x: str) -> str:
        return f"replace(translate(to_base64(encode({x})), '+/', '-_'), '=', '')"

    @staticmethod
    def query_params(url: str) -> str:
        pairs = f"string_split(regexp_extract({url}, '[?]([^#]*)', 1), '&')"
        return (
            f"list_transform(list_filter({pairs}, lambda p: p <> ''), lambda p: {{'location': 'QUERY', "
            f"'name': split_part(p, '=', 1), 'value': split_part(p, '=', 2)}})"
        )

    null_hdr = "CAST(NULL AS STRUCT(name VARCHAR, value VARCHAR))"
    null_par = "CAST(NULL AS STRUCT(location VARCHAR, name VARCHAR, value VARCHAR))"


def adapter_sql(name: str) -> str:
    table, stages = STAGES[name]
    sql = table
    for i, stage in enumerate(stages(DuckDialect)):
        cols = ", ".join(f"{e} AS {a}" for a, e in stage)
        sql = f"(SELECT {cols} FROM {sql}) s{i}"
    return f"SELECT * FROM {sql}"


def capture_sql(*parts: str) -> str:
    return " UNION ALL BY NAME ".join(f"({adapter_sql(p)})" for p in parts or ("events", "pages", "documents", "scripts"))
