"""DataFrame -> DataFrame operators.  Ordered / ranked work goes through
``prefix`` (distributed prefix sums, salted top-k); every random choice is an
md5 hash of row keys and a seed."""
