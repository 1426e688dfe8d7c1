"""Reading and writing observations, states, results and logs."""
