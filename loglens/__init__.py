"""loglens: web-server and proxy log analytics as Spark DataFrame plans.

Layout
------
``sources``    text scan, shell-style tokeniser, per-format parsers, ingest, rejects
``functions``  column-expression helpers: IP tests, URL parts, times, indicator patterns
``operators``  beacon scoring, proxy/web reports, indicators, suspicion index,
               page changes, search, IP report, enrichment joins
``plans``      table store and sinks, data-source registry, free SQL, stand-in inputs
``streaming``  the same parsers over ``readStream``
"""

__version__ = "0.1.0"
