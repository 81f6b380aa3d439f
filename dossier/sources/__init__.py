"""Sources and sinks: node, question and ranking tables, and the mapping of text tables to evidence nodes."""
