"""Table loading, canonical inputs, readers (O1-O10, O182) and sinks."""
