print("all scripts ran")
