"""Where operations come from: raw log files and tables."""
