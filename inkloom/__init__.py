"""Documents to Markdown at table scale, on Spark DataFrames.

convert(df, options, extra) and read_files(spark, path) convert; can_convert(df, registry) tells by hints alone.
"""

_LAZY = {"convert": "inkloom.plans.convert", "read_files": "inkloom.plans.convert", "to_json_lines": "inkloom.plans.convert", "can_convert": "inkloom.operators.registry", "registry": "inkloom.operators.registry", "convert_stream": "inkloom.streaming.ingest", "Options": "inkloom.model", "Hints": "inkloom.model", "Converter": "inkloom.sources.engine"}


def __getattr__(name: str):
    # Lazy, so that Python workers load no more than they need.
    if name in _LAZY:
        import importlib

        return getattr(importlib.import_module(_LAZY[name]), name)
    raise AttributeError(name)
