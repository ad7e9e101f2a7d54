"""DuckDB SQL that gives the same rows as each registered query."""

from oracles import content, crawling, policies, urls

ORACLES: dict[str, str] = {**urls.SQL, **content.SQL, **policies.SQL, **crawling.SQL}
