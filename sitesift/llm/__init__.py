"""Operators for training-data pipelines: documents, pages and conversations in, tables out.

Nothing else in the library imports this subpackage. Python runs inside tasks on Arrow batches; Spark partitions,
shuffles, joins and counts. Rules that all operators share:

* a null text is an empty text; a null id stays null and is sorted last;
* a row that is repeated with the same id and text counts as one document where positions are compared, and every
  repeated row gets the same result;
* operators read the columns they name and return their own, so extra columns with clashing names do no harm;
* an empty table gives an empty result with the same columns.
"""
