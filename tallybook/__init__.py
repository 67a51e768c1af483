"""Bank / ledger reconciliation as Spark DataFrame operators.

Every operator takes DataFrames and a list of ``keys`` (company, account, ...)
and returns DataFrames; nothing is pulled to the driver.
"""
