"""Readers and writers: page corpus, search results, state tables, exports."""
