"""Analytics over model-traffic logs, written as plain Spark DataFrame functions.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
and no state is kept between calls.
"""
