"""Jobs that run on a cluster: each a function that takes a session, and a command line with a small config file."""
