"""Site-screening analytics on Spark: tables in, tables out, every rule a DataFrame expression."""
