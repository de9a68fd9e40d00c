"""Views of search results and compaction of logs: many raw outputs in, one reduced text for each out, as DataFrame plans."""
