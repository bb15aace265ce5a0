"""DataFrame -> DataFrame operators of the panel."""
