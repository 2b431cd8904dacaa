"""Training-data operators: ten distributed building blocks for text corpora.

Nothing outside this subpackage imports it. Each module holds one operator;
``queries`` holds the registered queries and their SQL.
"""
