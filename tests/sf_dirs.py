"""Folders of the test tables. Not in ``conftest``: ``tests/llm`` has a module of that name too."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
