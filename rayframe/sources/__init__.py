"""Row sources and sinks: acquisition geometries, specifications, file formats."""
