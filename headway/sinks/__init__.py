"""Writers, table maintenance and exports."""
