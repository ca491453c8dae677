"""Small reference lists from public advisories and package indexes, as data.

Callers with longer lists pass their own DataFrames with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Packages and versions that public advisories describe as harmful.
# "*" means every version.
_COMPROMISED_2025_09 = "Release taken over in September 2025; it carried code that steals from crypto wallets."
KNOWN_BAD = {
    "npm": {
        "postmark-mcp": ([">=1.0.16"], "Copied every sent mail to an outside address."),
        "ansi-regex": (["6.2.1"], _COMPROMISED_2025_09),
        "ansi-styles": (["6.2.2"], _COMPROMISED_2025_09),
        "backslash": (["0.2.1"], _COMPROMISED_2025_09),
        "chalk": (["5.6.1"], _COMPROMISED_2025_09),
        "chalk-template": (["1.1.1"], _COMPROMISED_2025_09),
        "color": (["5.0.1"], _COMPROMISED_2025_09),
        "color-convert": (["3.1.1"], _COMPROMISED_2025_09),
        "color-name": (["2.0.1"], _COMPROMISED_2025_09),
        "color-string": (["2.1.1"], _COMPROMISED_2025_09),
        "debug": (["4.4.2"], _COMPROMISED_2025_09),
        "error-ex": (["1.3.3"], _COMPROMISED_2025_09),
        "has-ansi": (["6.0.1"], _COMPROMISED_2025_09),
        "is-arrayish": (["0.3.3"], _COMPROMISED_2025_09),
        "simple-swizzle": (["0.2.3"], _COMPROMISED_2025_09),
        "slice-ansi": (["7.1.1"], _COMPROMISED_2025_09),
        "strip-ansi": (["7.1.1"], _COMPROMISED_2025_09),
        "supports-color": (["10.2.1"], _COMPROMISED_2025_09),
        "supports-hyperlinks": (["4.1.1"], _COMPROMISED_2025_09),
        "wrap-ansi": (["9.0.1"], _COMPROMISED_2025_09),
        "event-stream": (["3.3.6"], "Pulled in a package that steals from wallets."),
        "flatmap-stream": (["*"], "Made to steal from wallets."),
        "ua-parser-js": (["0.7.29", "0.8.0", "1.0.0"], "Releases taken over to run a miner."),
        "coa": (["2.0.3", "2.0.4", "2.1.1", "2.1.3", "3.0.1", "3.1.3"], "Releases taken over to steal passwords."),
        "rc": (["1.2.9", "1.3.9", "2.3.9"], "Releases taken over to steal passwords."),
        "node-ipc": (["10.1.1", "10.1.2"], "Overwrote files by location."),
        "nx": (["20.9.0", "20.10.0", "20.11.0", "20.12.0", "21.5.0", "21.6.0", "21.7.0", "21.8.0"],
               "Install script collected tokens."),
        "crossenv": (["*"], "Imitated another package to steal environment variables."),
    },
    "pypi": {
        "ultralytics": (["8.3.41", "8.3.42", "8.3.45", "8.3.46"], "Releases that ran a miner."),
        "ctx": (["0.1.2", "0.2.2", "0.2.6"], "Sent environment variables away."),
        "colourama": (["*"], "Imitated another package to steal from wallets."),
        "jeilyfish": (["*"], "Imitated another package to steal keys."),
        "python3-dateutil": (["*"], "Imitated another package to steal keys."),
    },
}

# Names that attackers like to imitate.
POPULAR = {
    "npm": (
        "@modelcontextprotocol/sdk @modelcontextprotocol/inspector @modelcontextprotocol/server-filesystem "
        "@modelcontextprotocol/server-memory @modelcontextprotocol/server-github @modelcontextprotocol/server-postgres "
        "@modelcontextprotocol/server-everything @modelcontextprotocol/server-sequential-thinking @playwright/mcp "
        "@types/node angular async axios babel body-parser chalk cheerio commander cors debug dotenv electron esbuild "
        "eslint express fastify fs-extra glob jest jsdom jsonwebtoken lodash minimist moment mongodb mongoose morgan "
        "mysql2 next node-fetch nodemon openai passport playwright prettier puppeteer react react-dom redis request "
        "rimraf rollup rxjs semver sequelize sharp socket.io tailwindcss typescript undici uuid vite webpack winston "
        "ws yargs zod"
    ).split(),
    "pypi": (
        "aiohttp anthropic asyncpg attrs beautifulsoup4 boto3 celery certifi cffi charset-normalizer click colorama "
        "cryptography django fastapi fastmcp flask gunicorn httpx huggingface-hub idna jinja2 jsonschema langchain lxml "
        "matplotlib mcp mypy numpy openai packaging pandas paramiko pillow pip playwright psycopg2 pyarrow pydantic "
        "pygments pymongo pytest python-dateutil python-dotenv pyyaml redis requests rich scikit-learn scipy selenium "
        "setuptools six sqlalchemy starlette tensorflow torch tqdm transformers typing-extensions urllib3 uvicorn wheel"
    ).split(),
}
# Packages of good name within an edit of a popular one. Mostly the earlier list, three added, four left out.
REAL_NEIGHBOURS = (
    "attr", "boto", "colors", "jinja", "mysql", "openapi", "pipx", "preact", "psycopg", "redux", "request", "requests", "sqlite",
)
OFFICIAL_SCOPES = ("@modelcontextprotocol",)


def known_bad(spark: SparkSession) -> DataFrame:
    rows = [
        (eco, name, versions, summary, [])
        for eco, items in KNOWN_BAD.items()
        for name, (versions, summary) in items.items()
    ]
    return spark.createDataFrame(
        rows, "ecosystem string, name string, versions array<string>, summary string, references array<string>"
    )


def popular(spark: SparkSession) -> DataFrame:
    rows = [(eco, name) for eco, names in POPULAR.items() for name in names]
    return spark.createDataFrame(rows, "ecosystem string, name string")
