"""Jobs: work on whole tables with a command line and a configuration file."""
